"""Settings of one query, immutable and per query."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

OPERATORS = ("average", "max", "simplemax", "median", "simplemedian", "nulltest")
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


@dataclass(frozen=True)
class TileQuery:
    """Which variable, which records, which tiles, which operator.

    variable: "" is the last one in a file. low and high: records low <= c0 < high.
    slice_corner and slice_shape: a rectangle, of which alone a source reads.
    multi_file_mode: "concat" puts files one after another along the records,
    "combine" overlays them, "combine_folders" overlays folders, the files of each
    one after another. extraction_shape: None is one cell for each tile. ordered: results come in the
    order of their tile's index, over all partitions. sample_ratio, placement_mode,
    use_combiner, holistic and logfile are accepted and change nothing: Spark
    places tasks, always aggregates partially and finishes tiles exactly."""

    variable: str = ""
    low: int = INT_MIN
    high: int = INT_MAX
    extraction_shape: tuple[int, ...] | None = None
    operator: str = ""
    partition_mode: str = "record"
    placement_mode: str = "sampling"
    multi_file_mode: str = "concat"
    noscan: bool = True
    query_dependent: bool = False
    num_partitions: int = 1
    buffer_size: int = 8192
    sample_ratio: float = 0.01
    use_combiner: bool = True
    holistic: bool = False
    logfile: str = ""
    ordered: bool = False
    slice_corner: tuple[int, ...] | None = None
    slice_shape: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if (self.slice_corner is None) != (self.slice_shape is None) or len(self.slice_corner or ()) != len(self.slice_shape or ()):
            raise ValueError(f"a slice needs a corner and a shape of one rank: {self.slice_corner}, {self.slice_shape}")
        if self.extraction_shape is not None and any(e < 1 for e in self.extraction_shape):
            raise ValueError(f"extraction_shape needs positive sizes: {self.extraction_shape}")

    @classmethod
    def from_conf(cls, conf: Mapping[str, str]) -> TileQuery:
        """From strings, by key; what stands before a key's last dot is ignored, and so are unknown keys. Values that name no mode mean the fallback, as documented for each key."""
        out: dict = {}
        for key, raw in conf.items():
            name = _ALIASES.get(key.rpartition(".")[2], key.rpartition(".")[2])
            if name in _PARSERS:
                out[name] = _PARSERS[name](raw)
        return cls(**out)

    def with_(self, **changes) -> TileQuery:
        return replace(self, **changes)


#: Other spellings of the keys.
_ALIASES = {"variable_name": "variable", "low_filter": "low", "high_filter": "high", "query_dependant": "query_dependent", "number_reducers": "num_partitions"}


def _truth(raw: str) -> bool:
    return raw.strip().lower() == "true"


def _one_of(choices: tuple[str, ...], other: str):
    return lambda raw: raw.lower() if raw.lower() in choices else other


def _count(raw: str) -> int:
    try:
        return int(raw)
    except ValueError:
        return 1


_PARSERS = {f.name: {"str": str, "int": int, "float": float, "bool": _truth}.get(f.type, str) for f in fields(TileQuery)} | {
    **dict.fromkeys(("extraction_shape", "slice_corner", "slice_shape"), lambda raw: tuple(int(x) for x in raw.split(",")) if raw else None),
    "operator": lambda raw: raw.lower() if raw.lower() in OPERATORS else "",
    "partition_mode": _one_of(("proportional", "record", "calculated"), "proportional"),
    "placement_mode": _one_of(("roundrobin", "sampling", "implicit"), "roundrobin"),
    "multi_file_mode": _one_of(("combine", "combine_folders", "concat"), "combine"),
    "num_partitions": _count,
}
