"""Slowest stages from a Spark event log (no UI needed).

Usage: python tools/stage_times.py <event log file or folder> [top]
Run the bench with BENCH_EVENT_LOG=<scratch folder> to produce the log.
"""

from __future__ import annotations

import json
import os
import sys


def _files(path: str):
    if not os.path.isdir(path):
        yield path
        return
    for root, _dirs, names in os.walk(path):  # Spark 4 writes rolling log folders
        for n in sorted(names):
            if not (n.startswith("appstatus") or n.startswith(".") or n.endswith(".crc")):
                yield os.path.join(root, n)


def _lines(f: str):
    if f.endswith(".zstd") or f.endswith(".zst"):  # Spark 4 compresses event logs with zstd
        import io
        import zstandard
        with open(f, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8", errors="replace")
        return
    with open(f, encoding="utf-8", errors="replace") as fh:
        yield from fh


def stages(path: str):
    for f in _files(path):
        for line in _lines(f):
            try:
                ev = json.loads(line)
            except ValueError:
                continue
            if ev.get("Event") != "SparkListenerStageCompleted":
                continue
            info = ev["Stage Info"]
            start, end = info.get("Submission Time"), info.get("Completion Time")
            if start and end:
                yield (end - start) / 1000.0, info["Stage ID"], info["Number of Tasks"], info["Stage Name"]


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    rows = sorted(stages(path), reverse=True)[:top]
    for sec, sid, tasks, name in rows:
        print(f"{sec:8.2f}s  stage {sid:5d}  tasks {tasks:5d}  {name[:90]}")


if __name__ == "__main__":
    main()
