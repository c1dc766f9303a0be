"""Writers that never overwrite, and their sidecars."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from curatrix.operators.provenance import manifest_digest


def require_absent(paths: Iterable[str | Path]) -> None:
    if there := [str(p) for p in paths if os.path.lexists(p)]:
        raise FileExistsError(f"already there: {there}")


def write_json(path: str | Path, value: Mapping[str, Any]) -> None:
    """A new JSON file, keys sorted; an existing one is an error."""
    text = json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"
    with open(path, "x", encoding="utf-8", newline="\n") as f:
        f.write(text)


def write_npz(path: str | Path, **arrays: np.ndarray) -> None:
    with open(path, "xb") as f:
        np.savez_compressed(f, **arrays)


def copy_file(source: str | Path, target: str | Path) -> None:
    with open(source, "rb") as a, open(target, "xb") as b:
        shutil.copyfileobj(a, b)


def new_directory(path: str | Path) -> Path:
    Path(path).mkdir(parents=True, exist_ok=False)
    return Path(path)


def companion(path: str | Path, suffix: str) -> Path:
    """``stem.suffix`` beside a file."""
    p = Path(path)
    return p.with_name(f"{p.stem}.{suffix}")


def write_table(df: DataFrame, path: str) -> None:
    """New Parquet; an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str, order: Iterable[str] = ()) -> None:
    """New CSV with a header, in order; an empty table has its header too."""
    order = list(order)
    (df.orderBy(*order) if order else df).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_manifest(df: DataFrame, path: str) -> str:
    """A new manifest as one CSV table and its digest in ``path.sha256`` (a local or mounted path)."""
    require_absent([f"{path}.sha256"])
    digest = manifest_digest(df)
    write_csv(df, path, [c for c in ("image_name", "image_path", "sha256") if c in df.columns])
    with open(f"{path}.sha256", "x", encoding="ascii") as f:
        f.write(digest + "\n")
    return digest


def write_exclusions(df: DataFrame, path: str) -> None:
    write_csv(df.select("row_number", "image_name", "reason"), path, ["row_number", "image_name", "reason"])


def publish(temporary: str | Path, final: str | Path) -> None:
    """A finished file under its final name, at once; an existing one is an error."""
    os.link(temporary, final)
    os.unlink(temporary)


def copy_bundle(source: str | Path, target: str | Path, names: Iterable[str]) -> None:
    """Files of a run into a new directory."""
    folder = new_directory(target)
    for name in names:
        copy_file(Path(source) / name, folder / name)
