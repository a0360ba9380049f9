"""Settings and how they are resolved from flags, environment and defaults."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

VAULT_ENV = "KINDRED_VAULT_ROOT"
# Fixed values.
REPORTS_REL = "研究/98_論文レポート"
FOLDERS = ("00-General", "01-Simulation", "02-Security")


@dataclass(frozen=True)
class Thresholds:
    """Cutoffs of the graph; the defaults are the production ones."""

    a_min: float = 0.30
    a_specific_df: int = 200
    b_min: float = 0.55
    a_veto: float = 0.40
    top_k: int = 8
    cap: int = 10


@dataclass(frozen=True)
class Settings:
    vault_root: str
    reports_rel: str = REPORTS_REL
    folders: tuple[str, ...] = FOLDERS
    protected: tuple[str, ...] = ()
    cache_dir: str = ""
    db_path: str = ""
    limits: Thresholds = field(default_factory=Thresholds)

    @property
    def reports_dir(self) -> str:
        return f"{self.vault_root.rstrip('/')}/{self.reports_rel}"

    @property
    def embed_cache(self) -> str:
        return f"{self.cache_dir}/embeddings.parquet"

    @property
    def edge_dump(self) -> str:
        return f"{self.cache_dir}/edges.json"

    def ensure_cache_dir(self) -> None:
        if "://" not in self.cache_dir:  # elsewhere Spark's writers make it
            Path(self.cache_dir).mkdir(parents=True, exist_ok=True)


def resolve(
    vault_root: str | None = None,
    reports_rel: str | None = None,
    folders: tuple[str, ...] = (),
    protected: tuple[str, ...] = (),
    cache_dir: str | None = None,
    db_path: str | None = None,
    a_veto: float = 0.40,
    env: Mapping[str, str] | None = None,
) -> Settings:
    """A flag wins over the environment, that over the default. There is no default vault, and no default database without a home."""
    env = os.environ if env is None else env
    root = vault_root or env.get(VAULT_ENV)
    if not root:
        raise ValueError(f"vault root required: pass --vault-root or set {VAULT_ENV}")
    if not db_path:
        if not env.get("HOME"):
            raise ValueError("no home directory: pass --db-path")
        db_path = f"{env['HOME']}/.cache/kindred/papers.db"
    return Settings(root, reports_rel or REPORTS_REL, tuple(folders) or FOLDERS, tuple(protected), cache_dir or tempfile.gettempdir(), db_path, Thresholds(a_veto=a_veto))
