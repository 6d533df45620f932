"""Several repositories behind one surface: start-up, clones, index runs."""

from __future__ import annotations

import logging
import threading
from concurrent.futures import Future, ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions import vectors
from ..operators import architecture as arch
from ..sources import files, git_log
from ..sources.registry import Registry, Repo
from ..sources.schema import SCHEMAS
from ..sources.snapshot import SnapshotStore
from ..streaming import watcher
from .tools import Repositories, Tools

log = logging.getLogger(__name__)


class Host:
    """A registry of repositories, a snapshot store for each, and the tools over them.

    ``stores`` is a folder that all executors share; ``clones`` is where the driver
    clones to, so on a cluster it must be a path the executors can read, too.
    """

    def __init__(self, spark: SparkSession, registry: Registry, stores: str, clones: str, dim: int = vectors.DIM, timeout: int = 300):
        self.spark, self.registry, self.stores, self.clones, self.dim, self.timeout = spark, registry, stores.rstrip("/"), clones, dim, timeout
        self.repositories, self._under_way, self._lock = Repositories(), set(), threading.Lock()
        self._pool = ThreadPoolExecutor(2)

    def bootstrap(self, configured: dict[str, str]) -> list[str]:
        """Fill an empty registry from name -> path or URL, then open every repository that is cloned; their names."""
        if not self.registry.list():
            for name, source in configured.items():
                url = "://" in source
                self.registry.add(Repo(name, str(Path(self.clones, name)) if url else str(Path(source).resolve()), source if url else None, clone_status="Pending" if url else "Done"))
        for repo in self.registry.list():
            if repo.clone_status == "Done":
                self.open(repo)
        return self.repositories.names()

    def store(self, name: str) -> SnapshotStore:
        return SnapshotStore(self.spark, f"{self.stores}/{name.lower()}", self.dim)

    def open(self, repo: Repo) -> Tools:
        tools = Tools(self.spark, self._tables(repo.name), git_log.read_git(self.spark, repo.local_path), self.dim, repo.local_path, lambda: self._index(repo))
        tools.indexed_at = repo.last_indexed_at
        self.repositories.add(repo.name, tools)
        return tools

    def _tables(self, name: str) -> dict:
        return {t: self.store(name).read(t) for t in SCHEMAS}

    def _index(self, repo: Repo) -> dict:
        found = files.crawl(self.spark, repo.local_path)
        watcher.index_files(files.text_files(found), self.store(repo.name))
        if repo.name.lower() in map(str.lower, self.repositories.names()):
            self.repositories[repo.name].components = arch.discover_components(found)
        return self._tables(repo.name)

    def enqueue(self, name: str) -> Future | None:
        """Clone (where there is a URL) and index in the background; None if that is under way already."""
        with self._lock:
            if name.lower() in self._under_way:
                log.warning("%s is being indexed already", name)
                return None
            self._under_way.add(name.lower())
        return self._pool.submit(self._run, name)

    def _run(self, name: str) -> bool:
        repo = self.registry.get(name)
        try:
            if repo.git_url and repo.clone_status != "Done":
                self.registry.update(name, clone_status="Running")
                if not git_log.clone(repo.git_url, repo.local_path, repo.branch, self.timeout):
                    raise RuntimeError(f"clone of {repo.git_url} failed")
                self.registry.update(name, clone_status="Done")
            self.registry.update(name, index_status="Running")
            self.open(repo).rescan_repository()
            self.registry.update(name, index_status="Done", error_message=None)
            return True
        except Exception as e:  # the registry says what went wrong
            log.exception("indexing %s failed", name)
            state = {"clone_status": "Failed"} if repo.clone_status == "Running" else {"index_status": "Failed"}
            self.registry.update(name, error_message=str(e).splitlines()[0], **state)
            return False
        finally:
            with self._lock:
                self._under_way.discard(name.lower())
