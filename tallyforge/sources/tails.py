"""The last rate limit of session files, read from their ends.

A task opens each of its files, reads blocks of CHUNK bytes from the end and looks at whole lines, the last first, until one has a limit of the wanted
window. So what is read of a file is about the distance of its last limit from its end, however long the file is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

from ..staging import local_path

CHUNK = 64 * 1024
LIMITS = "file_path string, ms long, used_percent double, window_minutes long, resets_at long, problem string, bytes_read long"
_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})")
#: What a line may hold, as far as it is looked at; fields may be missing or null.
_LIMIT = {"used_percent": float, "window_minutes": int, "resets_at": int}
_ENTRY = {"timestamp": str, "type": str, "payload": {"type": str, "rate_limits": {"primary": _LIMIT, "secondary": _LIMIT}}}


class Malformed(ValueError):
    """A line that is no record; cut_off if it may go on."""

    def __init__(self, cut_off: bool = False):
        super().__init__("malformed line")
        self.cut_off = cut_off


def is_link(path: str) -> bool:
    """Whether a folder of this machine is a symbolic link; other stores have none."""
    uri = urlparse(path)
    return uri.scheme in ("", "file") and os.path.islink(unquote(uri.path))


def _fits(value, shape) -> bool:
    if value is None:
        return True
    if isinstance(shape, dict):
        return isinstance(value, dict) and all(_fits(value.get(k), s) for k, s in shape.items())
    if isinstance(value, bool):
        return False
    return isinstance(value, (int, float) if shape is float else shape)


def record(line: bytes) -> dict:
    """A line as a record of the fields that are looked at."""
    try:
        text = line.decode()
    except UnicodeDecodeError as e:
        raise Malformed(cut_off=e.reason == "unexpected end of data") from None
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        rest = text[e.pos :].strip()
        ends = not rest or e.msg.startswith(("Unterminated", "Invalid \\u")) or any(w.startswith(rest) for w in ("true", "false", "null", "-"))
        raise Malformed(cut_off=ends) from None
    if not isinstance(found, dict) or not _fits(found, _ENTRY):
        raise Malformed
    return found


def limit_of(line: bytes, minutes: int) -> tuple | None:
    """(timestamp in ms, used percent, window, reset) of a line with a limit of that window."""
    if not line.strip():
        return None
    entry = record(line)
    payload = entry.get("payload") or {}
    if entry.get("type") != "event_msg" or payload.get("type") != "token_count":
        return None
    windows = [w for w in map((payload.get("rate_limits") or {}).get, ("primary", "secondary")) if w is not None]
    if any(w.get(f) is None for w in windows for f in _LIMIT):
        raise Malformed
    for w in windows:
        if w["window_minutes"] == minutes:
            stamp = entry.get("timestamp")
            if stamp is None or not _STAMP.fullmatch(stamp):
                raise Malformed
            try:
                at = datetime.fromisoformat(stamp.upper().replace(" ", "T"))
            except ValueError:
                raise Malformed from None
            return int(at.timestamp()) * 1000 + at.microsecond // 1000, float(w["used_percent"]), w["window_minutes"], w["resets_at"]
    return None


def lines_from_end(file, size: int) -> Iterator[tuple[bytes, bool, int]]:
    """(line, whether it is the end of the file without a line end, bytes read so far), the last line first."""
    left, held, read, open_end = size, b"", 0, None
    while left > 0:
        n = min(CHUNK, left)
        left -= n
        file.seek(left)
        block = file.read(n)
        read += n
        if open_end is None:
            open_end = not block.endswith(b"\n")
        if b"\n" not in block:
            held = block + held
            continue
        first, *rest = (block + held).split(b"\n")
        for line in reversed(rest):
            yield line, open_end, read
            open_end = False
        held = first
    if held:
        yield held, bool(open_end), read


def last_limit(path: str, minutes: int) -> tuple:
    """A row of LIMITS for one file."""
    files, name = local_path(path)
    read = 0
    with files.open_input_file(name) as f:
        for line, open_end, read in lines_from_end(f, f.size()):
            try:
                found = limit_of(line, minutes)
            except Malformed as e:
                if e.cut_off and open_end:
                    continue
                return path, None, None, None, None, "malformed_line", read
            if found:
                ok = 0 <= found[1] <= 100
                return path, *found, None if ok else "invalid_percent", read
    return path, None, None, None, None, None, read


def last_limits(files: DataFrame, minutes: int) -> DataFrame:
    """A row of LIMITS for each file of (path, ...)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = [last_limit(p, minutes) for p in batch.column("path").to_pylist()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in LIMITS.split(", ")])

    return files.select("path").mapInArrow(read, LIMITS)
