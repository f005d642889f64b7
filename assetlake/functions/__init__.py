from assetlake.functions.durations import Duration, duration
from assetlake.functions.globs import glob_to_regex, matches_any_glob, matches_glob
from assetlake.functions.paths import join_path, uri_container
from assetlake.functions.text import decode_utf8, not_blank, split_lines

__all__ = [
    "Duration", "duration", "glob_to_regex", "matches_any_glob", "matches_glob", "join_path",
    "uri_container", "decode_utf8", "not_blank", "split_lines",
]
