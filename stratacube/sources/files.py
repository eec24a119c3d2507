"""Objects of a store by key: on any file system that pyarrow knows, or over HTTP."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

import pyarrow.fs

#: Seconds before each new try of a request that failed on the way or on the server's side.
RETRIES = (0.2, 0.6, 1.5)


class Files:
    """A folder on a local disk, HDFS, S3 and so on."""

    def __init__(self, root: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(root)

    def get(self, key: str) -> bytes | None:
        try:
            with self.fs.open_input_file(f"{self.root}/{key}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def size(self, key: str) -> int | None:
        info = self.fs.get_file_info(f"{self.root}/{key}")
        return info.size if info.type == pyarrow.fs.FileType.File else None

    def part(self, key: str, offset: int | None, length: int) -> bytes | None:
        """length bytes from offset on, or the last ones if offset is None."""
        try:
            with self.fs.open_input_file(f"{self.root}/{key}") as f:
                return f.read_at(length, f.size() - length if offset is None else offset)
        except FileNotFoundError:
            return None

    def put(self, key: str, data: bytes) -> None:
        path = f"{self.root}/{key}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(path) as f:
            f.write(data)

    def empty(self) -> bool:
        info = self.fs.get_file_info(self.root)
        if info.type == pyarrow.fs.FileType.NotFound:
            return True
        return info.type == pyarrow.fs.FileType.Directory and not self.fs.get_file_info(pyarrow.fs.FileSelector(self.root))

    def delete(self) -> None:
        if self.fs.get_file_info(self.root).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_dir(self.root)

    def inventory(self) -> list[tuple[str, int]]:
        """Keys and sizes of all objects."""
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, recursive=True))
        return sorted((i.path[len(self.root) :].lstrip("/"), i.size) for i in found if i.type == pyarrow.fs.FileType.File)


class HttpFiles:
    """A store behind a web server: reads only."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _request(self, key: str, range_: str | None = None, method: str = "GET"):
        headers = {"Range": range_} if range_ else {}
        for pause in (*RETRIES, None):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.root}/{key}", headers=headers, method=method), timeout=60) as r:
                    return r.status, dict(r.headers), r.read()
            except urllib.error.HTTPError as e:
                if e.code in (404, 416):
                    return e.code, dict(e.headers), b""
                if pause is None or not (e.code == 429 or e.code >= 500):
                    raise
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if pause is None:
                    raise
            time.sleep(pause)
        raise AssertionError("unreachable")

    def get(self, key: str) -> bytes | None:
        status, _, body = self._request(key)
        return body if status == 200 else None

    def size(self, key: str) -> int | None:
        status, headers, _ = self._request(key, method="HEAD")
        return int(headers["Content-Length"]) if status == 200 and "Content-Length" in headers else None

    def part(self, key: str, offset: int | None, length: int) -> bytes | None:
        range_ = f"bytes=-{length}" if offset is None else f"bytes={offset}-{offset + length - 1}"
        status, _, body = self._request(key, range_)
        if status in (404, 416):
            return None
        if status == 200:  # a server without ranges sends the whole
            return body[-length:] if offset is None else body[offset : offset + length]
        return body


def files(root: str) -> Files | HttpFiles:
    return HttpFiles(root) if root.startswith(("http://", "https://")) else Files(root)
