"""Files of a mounted folder or of any store that Hadoop knows, by one interface that works in tasks and in the driver.

``Mounted`` uses the operating system.  ``Store`` opens paths through the store's
own Hadoop file system: in the driver that of its session, in a task that of a
small JVM which the Python worker starts once, from Spark's own jars, and which
ends with the worker.  So a task sees hidden names, gets the error of one file
without failing, and reads the paths that it was given and nothing else.
"""

from __future__ import annotations

import contextlib
import functools
import glob
import io
import os
import re
import stat as modes
import uuid
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession

#: Bytes that are taken from a store at once.
BLOCK = 4 << 20


class Entry(NamedTuple):
    path: str
    is_folder: bool
    length: int
    changed: float  # seconds since 1970


class Mounted:
    """The local file tree, or what is mounted into it on every node."""

    def entries(self, folder: str) -> Iterator[Entry]:
        """What is directly in a folder, hidden names too; linked folders are left out, and what cannot be looked at has length and time 0."""
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield Entry(e.path, True, 0, 0.0)
                elif not e.is_dir():
                    try:
                        own = e.stat()
                        yield Entry(e.path, False, own.st_size, own.st_mtime)
                    except OSError:
                        yield Entry(e.path, False, 0, 0.0)

    def stat(self, path: str) -> Entry:
        own = os.stat(path)
        return Entry(path, modes.S_ISDIR(own.st_mode), own.st_size, own.st_mtime)

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def blocks(self, path: str, size: int = BLOCK) -> Iterator[bytes]:
        with open(path, "rb") as f:
            while block := f.read(size):
                yield block

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def seekable(self, path: str) -> io.BufferedIOBase:
        """The file for reading by place."""
        return open(path, "rb")

    def create(self, path: str) -> io.BufferedIOBase:
        """A new file to write to."""
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "xb")

    def rename(self, path: str, to: str) -> None:
        """Give a file its name, in place of another one that has it."""
        os.replace(path, to)

    def write(self, path: str, data: bytes) -> None:
        """Write a small file at once: readers see all of it or nothing."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.create(part) as f:
            f.write(data)
        self.rename(part, path)

    def remove(self, path: str) -> None:
        """Remove a file, or a folder with all that is in it; none is no error."""
        import shutil

        if os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path, ignore_errors=True)
        else:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)


@functools.cache
def _own_jvm():
    """The JVM beside this Python worker."""
    from py4j.java_gateway import GatewayParameters, JavaGateway, launch_gateway
    from pyspark.find_spark_home import _find_spark_home

    jars = os.path.join(os.environ.get("SPARK_HOME") or _find_spark_home(), "jars")
    places = [os.environ.get(x) for x in ("HADOOP_CONF_DIR", "YARN_CONF_DIR")] + [os.path.join(jars, "*")]
    java = os.path.join(os.environ["JAVA_HOME"], "bin", "java") if os.environ.get("JAVA_HOME") else "java"
    port, token = launch_gateway(jarpath=glob.glob(os.path.join(jars, "py4j-*.jar"))[0], classpath=os.pathsep.join(filter(None, places)), javaopts=["-Xmx256m", "-XX:+UseSerialGC"], die_on_exit=True, java_path=java, enable_auth=True)
    return JavaGateway(gateway_parameters=GatewayParameters(port=port, auth_token=token)).jvm


class Placed(io.RawIOBase):
    """A stream of a store, for reading by place."""

    def __init__(self, store: Store, stream, length: int):
        self.store, self.stream, self.length, self.at = store, stream, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.length}[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), max(0, self.length - self.at))
        if n:
            with self.store._told():
                self.stream.seek(self.at)
                data = bytes(self.stream.readNBytes(n))
            n = len(data)
            buffer[:n] = data
            self.at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


class Written(io.RawIOBase):
    """A stream of a store that is written to."""

    def __init__(self, store: Store, stream):
        self.store, self.stream = store, stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        with self.store._told():
            self.stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            with self.store._told():
                self.stream.close()
        super().close()


class Store:
    """A store by its Hadoop file system.  ``settings`` is the session's Hadoop configuration as XML."""

    def __init__(self, settings: str, jvm=None):
        self.settings, self._jvm, self._conf = settings, jvm, None

    def __getstate__(self) -> dict:
        return {"settings": self.settings, "_jvm": None, "_conf": None}

    def _at(self, path: str):
        if self._conf is None:
            self._jvm = self._jvm or _own_jvm()
            self._conf = self._jvm.org.apache.hadoop.conf.Configuration(False)
            self._conf.addResource(self._jvm.java.io.ByteArrayInputStream(self.settings.encode()))
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    @contextlib.contextmanager
    def _told(self):
        """A failure of the store as an OSError with its message."""
        from py4j.protocol import Py4JJavaError

        try:
            yield
        except Py4JJavaError as e:
            cause = e.java_exception
            raise (FileNotFoundError if "FileNotFound" in cause.getClass().getName() else OSError)(cause.toString()) from None

    @staticmethod
    def _entry(status) -> Entry:
        return Entry(status.getPath().toString(), status.isDirectory(), status.getLen(), status.getModificationTime() / 1000)

    def entries(self, folder: str) -> Iterator[Entry]:
        with self._told():
            fs, place = self._at(folder)
            found = fs.listStatusIterator(place)
            while found.hasNext():
                yield self._entry(found.next())

    def stat(self, path: str) -> Entry:
        with self._told():
            fs, place = self._at(path)
            return self._entry(fs.getFileStatus(place))

    def exists(self, path: str) -> bool:
        with self._told():
            fs, place = self._at(path)
            return fs.exists(place)

    def blocks(self, path: str, size: int = BLOCK) -> Iterator[bytes]:
        with self._told():
            fs, place = self._at(path)
            stream = fs.open(place)
            try:
                while block := bytes(stream.readNBytes(size)):
                    yield block
            finally:
                stream.close()

    def read(self, path: str) -> bytes:
        return b"".join(self.blocks(path))

    def seekable(self, path: str) -> io.BufferedIOBase:
        with self._told():
            fs, place = self._at(path)
            return io.BufferedReader(Placed(self, fs.open(place), fs.getFileStatus(place).getLen()), 64 << 10)

    def create(self, path: str) -> io.BufferedIOBase:
        with self._told():
            fs, place = self._at(path)
            return io.BufferedWriter(Written(self, fs.create(place, False)), BLOCK)

    def rename(self, path: str, to: str) -> None:
        with self._told():
            fs, place = self._at(path)
            _, target = self._at(to)
            fs.delete(target, False)
            if not fs.rename(place, target):
                raise OSError(f"{to} could not be written")

    def write(self, path: str, data: bytes) -> None:
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.create(part) as f:
            f.write(data)
        self.rename(part, path)

    def remove(self, path: str) -> None:
        with self._told():
            fs, place = self._at(path)
            fs.delete(place, True)


def is_mounted(path: str) -> bool:
    """Whether a path is of the local file tree, not of another store."""
    return not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) or path.startswith("file:/")


def local_path(path: str) -> str:
    return re.sub(r"\Afile:/+", "/", path)


def files_of(spark: SparkSession, path: str) -> tuple[Mounted | Store, str]:
    """The files that a path is of, and the path as they take it."""
    if is_mounted(path):
        return Mounted(), local_path(path)
    jvm, out = spark._jvm, spark._jvm.java.io.StringWriter()
    spark._jsc.hadoopConfiguration().writeXml(out)
    return Store(out.toString(), jvm), path


def exists(spark: SparkSession, path: str) -> bool:
    files, place = files_of(spark, path)
    return files.exists(place)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one that ``spark.checkpoint.dir`` names, or a temporary one where it is unset and the master local."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table or folder, of any store."""
    files, place = files_of(spark, path)
    files.remove(place)
