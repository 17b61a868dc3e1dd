"""Mixture configuration: groups of datasets, their places and weights, as small typed rows.

A configuration is a mapping of group name to options; it becomes one row for
each dataset of a group.  Unknown options are an error rather than ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession

#: Kinds of datasets that the package can plan.
KINDS = ("text_image", "text_video", "conversation", "tar_pairs", "edit_pairs", "parquet_video", "latents")
_SCHEMA = "group_idx int, group_name string, weight double, is_mandatory boolean, kind string, dataset_name string, num_used bigint, shuffle_seed int, options string"


@dataclass(frozen=True)
class Group:
    """One group of a mixture."""

    name: str
    dataset_names: tuple[str, ...]
    kind: str = "text_image"
    weight: float = 1.0
    is_mandatory: bool = False
    num_used_data: tuple[int, ...] = ()
    shuffle_seed: int = 0
    options: Mapping[str, object] = field(default_factory=dict)


def groups_of(config: Mapping[str, Mapping[str, object]]) -> list[Group]:
    """Checked groups in the order of the configuration."""
    known = {f.name for f in fields(Group)} - {"name"}
    out = []
    for name, options in config.items():
        extra = set(options) - known
        if extra:
            raise ValueError(f"group {name}: unknown options {sorted(extra)}")
        g = Group(name, **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
        if g.kind not in KINDS:
            raise ValueError(f"group {name}: unknown kind {g.kind}")
        if g.weight < 0 or (g.num_used_data and len(g.num_used_data) != len(g.dataset_names)):
            raise ValueError(f"group {name}: weights are not negative and counts match the datasets")
        out.append(g)
    if not any(g.weight > 0 for g in out):
        raise ValueError("some group needs a weight above 0")
    return out


def load_config(path: str) -> dict[str, dict[str, object]]:
    """A configuration file: JSON, or YAML where a YAML library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML library; JSON needs none") from e
        return yaml.safe_load(text)
    return json.loads(text)


def catalog(spark: SparkSession, config: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """A row for each dataset of each group."""
    rows = [
        (i, g.name, float(g.weight), g.is_mandatory, g.kind, d, g.num_used_data[j] if g.num_used_data else None, g.shuffle_seed, json.dumps(dict(g.options), sort_keys=True))
        for i, g in enumerate(groups_of(config))
        for j, d in enumerate(g.dataset_names)
    ]
    return spark.createDataFrame(rows, _SCHEMA)


# --- plug-ins: named transforms of frames and columns ---------------------------

_TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}
_FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register_transform(name: str, f: Callable[..., DataFrame]) -> None:
    """Makes ``f(df, **options) -> df`` available by name, e.g. as a dataset's row parser."""
    if name in _TRANSFORMS:
        raise ValueError(f"transform {name} is registered already")
    _TRANSFORMS[name] = f


def register_function(name: str, f: Callable[..., Column]) -> None:
    """Makes ``f(*columns, **options) -> column`` available by name, e.g. as a frame or text sampler."""
    if name in _FUNCTIONS:
        raise ValueError(f"function {name} is registered already")
    _FUNCTIONS[name] = f


def transform(df: DataFrame, name: str, **options) -> DataFrame:
    return _TRANSFORMS[name](df, **options)


def function(name: str, *columns: Column, **options) -> Column:
    return _FUNCTIONS[name](*columns, **options)


def registered() -> tuple[list[str], list[str]]:
    return sorted(_TRANSFORMS), sorted(_FUNCTIONS)
