"""Registry of repositories: a small driver-side table, kept as JSON lines where a path is given."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STATUSES = ("Pending", "Running", "Done", "Failed")


@dataclass
class Repo:
    name: str
    local_path: str
    git_url: str | None = None
    branch: str | None = None
    clone_status: str = "Pending"
    index_status: str = "Pending"
    error_message: str | None = None
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    last_indexed_at: str | None = None


class Registry:
    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.repos: dict[str, Repo] = {}
        if self.path and self.path.exists():
            for line in self.path.read_text().splitlines():
                repo = Repo(**json.loads(line))
                self.repos[repo.name.lower()] = repo

    def _save(self) -> None:
        if self.path:
            self.path.write_text("".join(json.dumps(asdict(r)) + "\n" for r in self.list()))

    def list(self) -> list[Repo]:
        return sorted(self.repos.values(), key=lambda r: r.name)

    def get(self, name: str) -> Repo | None:
        return self.repos.get(name.lower())

    def add(self, repo: Repo) -> Repo:
        if repo.name.lower() in self.repos:
            raise ValueError(f"repository {repo.name!r} exists")
        self.repos[repo.name.lower()] = repo
        self._save()
        return repo

    def update(self, name: str, **changes) -> Repo:
        repo = self.repos[name.lower()]
        for k, v in changes.items():
            if k.endswith("_status") and v not in STATUSES:
                raise ValueError(f"{v!r} is no status")
            setattr(repo, k, v)
        if changes.get("index_status") == "Done":
            repo.last_indexed_at = datetime.now(UTC).isoformat()
        self._save()
        return repo

    def delete(self, name: str) -> bool:
        found = self.repos.pop(name.lower(), None) is not None
        self._save()
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = ", ".join(f"{f} string" for f in Repo.__dataclass_fields__)
        return spark.createDataFrame([tuple(asdict(r).values()) for r in self.list()], schema)
