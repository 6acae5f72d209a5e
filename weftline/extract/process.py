"""Extractors that are programs: each task runs the command over its files and streams what it prints.

The program gets one line of JSON for each file on its standard input, {"path": ..., "content": ...}, and the arguments
``--protocol`` and, if given, ``--analysis-mode``; it prints events, one line of JSON each. Files are dealt over the tasks of the
plan, so a tree of any size is split, and the same works for a stream of files. What a task prints is read while it still
reads; neither side is held in memory.

A line that is no valid event, a status other than 0, a line over ``MOST_LINE`` bytes or a task that takes longer than ``timeout``
seconds ends the program and fails the job, with the end of what it wrote to its standard error. A task that Spark runs again
starts the program again. A task without files starts nothing; null contents are empty, null paths aren't sent. Blank lines
are no events.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import threading
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources import events as E

MOST_LINE, BATCH, TAIL = 50 * 1024 * 1024, 2000, 2000


def lines_of(files: Iterator[tuple[str, str]], command: list[str], env: dict[str, str], timeout: float | None) -> Iterator[str]:
    """What the program prints for some files, line by line."""
    first = next(files, None)
    if first is None:
        return
    with tempfile.TemporaryFile() as said:
        run = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=said, env=os.environ | env)
        failed: list[BaseException] = []

        def feed() -> None:
            try:
                for path, content in (x for part in ([first], files) for x in part):
                    run.stdin.write(json.dumps({"path": path, "content": content or ""}).encode() + b"\n")
                run.stdin.close()
            except BrokenPipeError:
                pass  # it stopped reading; its status tells whether that is an error
            except BaseException as e:  # the input failed: so does the task
                failed.append(e)
                run.kill()

        feeder = threading.Thread(target=feed, daemon=True)
        clock = threading.Timer(timeout, run.kill) if timeout else None
        began = time.monotonic()
        try:
            feeder.start()
            if clock:
                clock.start()
            while line := run.stdout.readline(MOST_LINE + 1):
                if len(line) > MOST_LINE:
                    raise RuntimeError(f"{command[0]} printed a line of more than {MOST_LINE} bytes")
                if line.strip():
                    yield line.decode()
            status = run.wait()
            feeder.join()
            if failed:
                raise failed[0]
            if status:
                said.seek(max(0, said.seek(0, os.SEEK_END) - TAIL))
                late = " (stopped at its time limit)" if timeout and time.monotonic() - began >= timeout else ""
                raise RuntimeError(f"{command[0]} ended with status {status}{late}: {said.read().decode(errors='replace')}")
        finally:
            if clock:
                clock.cancel()
            if run.poll() is None:
                run.kill()
                run.wait()


def extract(files: DataFrame, command: list[str], protocol: str = E.PROTOCOL, mode: str = "", env: dict[str, str] | None = None, timeout: float | None = None) -> DataFrame:
    """The events that a command makes of ``files`` (path, content), checked; their order is that of their text."""
    whole, extra = [*command, "--protocol", protocol, *(["--analysis-mode", mode] if mode else [])], dict(env or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, c) for b in batches for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) if p is not None)
        held: list[str] = []
        for line in lines_of(rows, whole, extra, timeout):
            held.append(line.rstrip("\r\n"))
            if len(held) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    found = E.parse(files.select("path", "content").mapInArrow(run, "value string"))
    return E.require_valid(found, protocol).withColumn("seq", F.col("raw"))
