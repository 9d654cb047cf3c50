"""The lock that keeps two ticks from running at once: one winner of many takers, for ten minutes."""
from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from ..functions.dates import LOCK_MINUTES


def _created(spark: SparkSession, fs, path, data: bytes) -> bool:
    """Create a file that nobody has created before.

    A store's own exclusive create decides; a local file system's client only looks
    first, so there the operating system does.
    """
    if fs.getUri().getScheme() == "file":
        try:
            handle = os.open(unquote(urlparse(path.toUri().toString()).path), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        return True
    try:
        stream = fs.create(path, False)
    except Exception:
        if fs.exists(path):
            return False
        raise
    stream.write(data)
    stream.close()
    return True


def take(spark: SparkSession, folder: str, now: datetime, minutes: int = LOCK_MINUTES) -> bool:
    """Whether this caller may run a tick: nobody holds the lock, or its last taker came ``minutes`` or more ago.

    Each taking creates the next numbered file under ``folder`` of the shared file system, which
    only one of several callers can.  The file holds the time it was taken; one that is still
    empty has just been taken, or its taker died, so the file's own time counts.
    """
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(""))
    files = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path(""))]
    held = sorted((int(name[4:]), touched) for name, touched in files if name.startswith("tick"))
    number = 0
    if held:
        number, touched = held[-1]
        stream = fs.open(path(f"tick{number}"))
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        taken = datetime.fromisoformat(text) if text else datetime.fromtimestamp(touched / 1000, timezone.utc).replace(tzinfo=None)
        if now - taken < timedelta(minutes=minutes):
            return False
    won = _created(spark, fs, path(f"tick{number + 1}"), now.isoformat().encode())
    if won:
        for old, _ in held[:-1]:
            fs.delete(path(f"tick{old}"), False)
    return won
