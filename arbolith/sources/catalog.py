"""Datasets by name: registration, subsets, and the short syntax that loads them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from arbolith.operators.chats import renamed, standard
from arbolith.operators.sampling import sample_exactly
from arbolith.sources.files import read

Prepare = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Subset:
    name: str
    path: str | None = None  # below the dataset's; its own name by default
    splits: tuple[str, ...] = ("train",)
    weak: bool = False  # not part of 'all'


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    subsets: tuple[Subset, ...] = ()
    columns: dict[str, str] = field(default_factory=dict)
    prepare: Prepare | None = None
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Request:
    """What the syntax [hub::]name_or_path[:subset/subset][#count] asks for."""

    name: str
    hub: str | None = None
    subsets: tuple[str, ...] = ()
    count: int | None = None


SYNTAX = re.compile(r"^(?:(?P<hub>[a-z]+)::)?(?P<name>[^:#]+)(?::(?P<subsets>[^#]*))?(?:#(?P<count>\d+))?$")


def parse(text: str, exists: Callable[[str], bool] = os.path.exists) -> Request:
    """A request; a path that exists is taken as it stands, whatever separators it holds."""
    if exists(text):
        return Request(text)
    head, mark, count = text.rpartition("#")
    if mark and count.isdigit() and exists(head):
        return Request(head, count=int(count))
    m = SYNTAX.match(text)
    if not m:
        raise ValueError(f"not a dataset: {text!r}")
    subsets = tuple(s for s in (m["subsets"] or "").split("/") if s)
    return Request(m["name"], m["hub"], subsets, int(m["count"]) if m["count"] else None)


class Catalog:
    """The registered datasets; loading is lazy."""

    def __init__(self) -> None:
        self.datasets: dict[str, Dataset] = {}

    def register(self, dataset: Dataset, exist_ok: bool = False) -> None:
        if dataset.name in self.datasets and not exist_ok:
            raise ValueError(f"dataset {dataset.name!r} is registered already")
        self.datasets[dataset.name] = dataset

    def register_json(self, source: str, exist_ok: bool = False) -> list[str]:
        """Datasets of a JSON list, as text or in a file; paths are relative to the file."""
        base = os.path.dirname(source) if os.path.exists(source) else ""
        text = open(source).read() if base or os.path.exists(source) else source
        names = []
        for d in json.loads(text):
            path = d["path"] if os.path.isabs(d["path"]) or not base else os.path.join(base, d["path"])
            subsets = tuple(Subset(**(s if isinstance(s, dict) else {"name": s})) for s in d.get("subsets", ()))
            self.register(Dataset(d.get("name", path), path, subsets, d.get("columns", {}), tags=tuple(d.get("tags", ()))), exist_ok)
            names.append(d.get("name", path))
        return names

    def find(self, name: str) -> Dataset:
        """By name, by path, by the last part of the name, or as a path of its own."""
        by_path = {d.path: d for d in self.datasets.values()}
        by_end = {d.name.rsplit("/", 1)[-1]: d for d in self.datasets.values()}
        end = name.rstrip("/").rsplit("/", 1)[-1]
        return self.datasets.get(name) or by_path.get(name) or by_end.get(end) or Dataset(name, name)

    def select(self, dataset: Dataset, wanted: Sequence[str]) -> list[Subset | None]:
        """No subset asked for: the only one, or 'default'; 'all': all but weak ones; an unknown name: a folder of that name."""
        have = {s.name: s for s in dataset.subsets}
        if not wanted:
            if len(have) <= 1:
                return list(have.values()) or [None]
            if "default" in have:
                return [have["default"]]
            raise ValueError(f"{dataset.name}: name a subset of {sorted(have)}")
        if list(wanted) == ["all"] and "all" not in have:
            return [s for s in have.values() if not s.weak] or [None]
        return [have.get(s) or Subset(s) for s in wanted]

    def load(self, spark: SparkSession, text: str, seed: int = 42, key: str | None = None, keep_all: bool = False) -> DataFrame:
        """The rows of a request: each subset read, renamed, prepared and pruned, then all concatenated, then sampled to the count."""
        request = parse(text)
        dataset = self.find(request.name)
        frames = []
        for subset in self.select(dataset, request.subsets):
            paths = [dataset.path] if subset is None else [f"{dataset.path}/{subset.path or subset.name}"]
            for path in paths:
                df = renamed(read(spark, path), dataset.columns)
                df = dataset.prepare(df) if dataset.prepare else df
                frames.append(df if keep_all or dataset.prepare is None else standard(df))
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if request.count is None:
            return out
        return sample_exactly(out, request.count, seed, *([key] if key else out.columns[:1])).drop("copy")
