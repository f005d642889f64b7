from assetlake.sources.buckets import Bucket, Folder
from assetlake.sources.files import manifest, read_lines, read_texts, scan_files
from assetlake.sources.formats import TableFormat, read_table, snapshot_sink, write_table

__all__ = [
    "Bucket", "Folder", "manifest", "read_lines", "read_texts", "scan_files",
    "TableFormat", "read_table", "snapshot_sink", "write_table",
]
