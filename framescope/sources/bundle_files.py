"""Files of bundles as rows, listed and read by tasks: the driver knows the folders that a path names, but none of the files below them.

Spark's file sources list every file on the driver and keep its status for each reading, so a folder of many small files fills the driver. Here tasks
list bundles, the listing is a table in the shared folder, and tasks read what its parts name. The size of that is unknown to Spark, as it should be: a
table of names tells nothing of the contents, and by its size Spark would broadcast them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession

from framescope.functions.batches import BATCH_ROWS, map_batches
from framescope.sources.capture_index import READ_BYTES, Window, heads
from framescope.sources.pcap import _TYPES, HEADER_BYTES, IEEE802_11, PACKET_SCHEMA, RADIOTAP, RECORD_BYTES, batched, read_header
from framescope.sources.stores import shared_dir, store_of

LISTING_SCHEMA = "root string, bundle_id string, file string, size long"
_TEXT, _LONG, _BYTES = pa.string(), pa.int64(), pa.binary()
#: What a reading gives of each file: its schema and types, and the place of the value that bounds a batch.
GIVEN = {
    "content": ("bundle_id string, file string, content binary", [_TEXT, _TEXT, _BYTES], 2),
    "digest": ("bundle_id string, file string, digest string", [_TEXT, _TEXT, _TEXT], 2),
    "packets": (PACKET_SCHEMA, _TYPES, 6),
}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _folders(spark: SparkSession, folder: str) -> list[str]:
    """URIs of the folders that a path names; globs are those of Spark's readers."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return [x.getPath().toUri().toString() for x in found or () if x.isDirectory()]


def _shared(spark: SparkSession) -> str | None:
    """The shared folder, if there is one in a store that pyarrow knows."""
    try:
        store_of(shared_dir(spark))
    except (pa.ArrowException, OSError, ValueError):
        return None
    return shared_dir(spark)


def _reached(uri: str) -> bool:
    """Whether pyarrow knows the store, and sees the folder there."""
    try:
        store, place = store_of(uri)
        return store.get_file_info(place).type == arrow_fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def _bundles_of(rows: pa.RecordBatch) -> Iterator[tuple]:
    for root in rows.column("root").to_pylist():
        store, place = store_of(root)
        yield from ((root, x.base_name) for x in store.get_file_info(arrow_fs.FileSelector(place)) if x.type == arrow_fs.FileType.Directory)


def _files_of(rows: pa.RecordBatch) -> Iterator[tuple]:
    """Spark's readers pass over names with a leading underscore or dot, and so does this."""
    stores: dict[str, tuple[arrow_fs.FileSystem, str]] = {}
    for root, bundle in zip(rows.column("root").to_pylist(), rows.column("bundle_id").to_pylist()):
        store, place = stores.get(root) or stores.setdefault(root, store_of(root))
        found = store.get_file_info(arrow_fs.FileSelector(f"{place}/{bundle}"))
        yield from ((root, bundle, x.base_name, x.size) for x in found if x.type == arrow_fs.FileType.File and not x.base_name.startswith(("_", ".")))


def _mapped(df: DataFrame, rows_of: Callable[[pa.RecordBatch], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from batched((row for batch in batches for row in rows_of(batch)), _names(schema), types, 1)

    return map_batches(df, run, schema)


def list_files(spark: SparkSession, folder: str) -> str | None:
    """The place of a table (root, bundle_id, file, size) of the files right in the bundles below a folder (a glob will do), empty files too. None if
    pyarrow doesn't know the store of a folder or of the shared one, or if there is no such folder.

    One task lists the bundles of a folder, many tasks the files of its bundles."""
    roots, shared = _folders(spark, folder), _shared(spark)
    if not roots or shared is None or not all(map(_reached, roots)):
        return None
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bundles = _mapped(spark.createDataFrame([(r,) for r in roots], "root string").repartition(min(parts, len(roots))), _bundles_of, "root string, bundle_id string", [_TEXT, _TEXT])
    listing = f"{shared}/files-{uuid.uuid4().hex}"
    _mapped(bundles.repartition(parts, "root", "bundle_id"), _files_of, LISTING_SCHEMA, [_TEXT, _TEXT, _TEXT, _LONG]).write.parquet(listing)
    return listing


def _packets_of(bundle: str, file: pa.NativeFile, size: int, most: int) -> Iterator[tuple]:
    """A capture's rows, as read_packets gives them, read a block at a time."""
    head = read_header(file.read(min(HEADER_BYTES, size)), (IEEE802_11, RADIOTAP))
    if isinstance(head, str):
        yield bundle, 0, None, None, None, None, None, head
        return
    window = Window(file, size)
    for frame, at, found in heads(window, head, HEADER_BYTES, size, 0, most):
        if isinstance(found, str):
            yield bundle, frame, head.link, None, None, None, None, found
        else:
            yield bundle, frame, head.link, *found, window.bytes_at(at + RECORD_BYTES, found[1]), None


def _listed_rows(listing: str, files: list[str], give: str, most: int) -> Iterator[tuple]:
    """Rows of the files of some names that a part of a listing has."""
    store, place = store_of(listing)
    stores: dict[str, tuple[arrow_fs.FileSystem, str]] = {}
    with store.open_input_file(place) as listed:
        for r in (r for batch in pq.ParquetFile(listed).iter_batches(BATCH_ROWS) for r in batch.to_pylist() if r["size"] and r["file"] in files):
            at, base = stores.get(r["root"]) or stores.setdefault(r["root"], store_of(r["root"]))
            with at.open_input_file(f"{base}/{r['bundle_id']}/{r['file']}") as file:
                if give == "packets":
                    yield from _packets_of(r["bundle_id"], file, r["size"], most)
                elif give == "digest":
                    digest = hashlib.sha256()
                    while block := file.read(READ_BYTES):
                        digest.update(block)
                    yield r["bundle_id"], r["file"], digest.hexdigest()
                else:
                    yield r["bundle_id"], r["file"], file.read()


def read_listed(spark: SparkSession, listing: str, files: list[str], give: str = "content", most: int = 1 << 20) -> DataFrame:
    """Rows of the files of some names that a listing has. give: content or digest, with bundle_id and file; packets as read_packets gives them, with the
    bundle as path, read a block at a time. Empty files are passed over, as by Spark's binary reader.

    A Python data source would do the same, but each of its scans holds a worker of its own beside the driver."""
    schema, types, sized = GIVEN[give]
    store, place = store_of(listing)
    parts = [(x.base_name,) for x in store.get_file_info(arrow_fs.FileSelector(place)) if x.base_name.endswith(".parquet")]
    named = spark.createDataFrame(spark.sparkContext.parallelize(parts, max(1, len(parts))), "part string")  # from an RDD, whose size Spark doesn't know

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        every = (row for batch in batches for part in batch.column("part").to_pylist() for row in _listed_rows(f"{listing}/{part}", files, give, most))
        yield from batched(every, _names(schema), types, sized)

    return map_batches(named, run, schema)
