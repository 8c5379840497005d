"""Strict declarative configurations, compiled to an immutable plan."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from kinfold.functions.normalise import TRANSFORMS
from kinfold.operators.blocking import AllOf, AnyOf, DateWindow, Exact, Prefix
from kinfold.operators.decisions import Policy
from kinfold.operators.features import Anchor, Comparison
from kinfold.sources.readers import FORMATS

MAX_BYTES, MAX_DEPTH, MAX_NODES, MAX_ALIASES = 2 * 1024 * 1024, 64, 100_000, 64
CONSTRAINTS = ("one_to_one", "many_to_one", "one_to_many", "unconstrained")
MODES = ("link_only", "dedupe_only", "link_and_dedupe")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class ConfigError(ValueError):
    """A configuration that is not sound; the message names the place."""


def load_config(path: str) -> dict:
    """A YAML or JSON mapping within limits of size, depth, nodes and aliases; no repeated or merge keys."""
    text = Path(path).read_bytes()
    if len(text) > MAX_BYTES:
        raise ConfigError("CONFIG: file too large")
    return parse_config(text.decode("utf-8"))


def parse_config(text: str) -> dict:
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(set(map(str, keys))) != len(keys) or "<<" in keys:
            raise ConfigError("CONFIG: keys repeat or merge")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    aliases = sum(isinstance(e, yaml.events.AliasEvent) for e in yaml.parse(text, Loader=yaml.SafeLoader))
    if aliases > MAX_ALIASES:
        raise ConfigError("CONFIG: too many aliases")
    data = yaml.load(text, Loader=Strict)  # noqa: S506  (a SafeLoader)
    if not isinstance(data, dict):
        raise ConfigError("CONFIG: not a mapping")
    count = 0
    stack = [(data, 1)]
    while stack:
        node, depth = stack.pop()
        count += 1
        if depth > MAX_DEPTH or count > MAX_NODES:
            raise ConfigError("CONFIG: too deep or too large")
        if isinstance(node, dict):
            stack += [(v, depth + 1) for v in node.values()]
        elif isinstance(node, list):
            stack += [(v, depth + 1) for v in node]
    return data


@dataclass(frozen=True)
class Dataset:
    id: str
    path: str
    format: str
    identity: str
    columns: tuple  # (variable, source column)


@dataclass(frozen=True)
class LinkagePlan:
    mode: str
    constraint: str
    datasets: tuple
    variables: dict
    rules: dict
    comparisons: tuple
    anchors: tuple
    policy: Policy
    pair_budget: int
    prior: float
    fractions: dict
    digest: str


def _keys(where: str, data: dict, need: set, may: set = frozenset()) -> dict:
    if not isinstance(data, dict) or not need <= set(data) <= need | may:
        raise ConfigError(f"CONFIG: {where} must have {sorted(need)} and may have {sorted(may)}")
    return data


def _predicate(where: str, data: dict, types: dict):
    if "all" in data or "any" in data:
        kind = "all" if "all" in data else "any"
        _keys(where, data, {kind})
        return (AllOf if kind == "all" else AnyOf)(tuple(_predicate(where, p, types) for p in data[kind]))
    kind = data.get("kind")
    name = data.get("variable")
    if name not in types:
        raise ConfigError(f"CONFIG: {where} names an unknown variable")
    if kind == "exact":
        _keys(where, data, {"kind", "variable"})
        return Exact(name)
    if kind == "prefix" and types[name] in ("string", "categorical"):
        return Prefix(name, _keys(where, data, {"kind", "variable", "length"})["length"])
    if kind == "date_window" and types[name] == "date":
        return DateWindow(name, _keys(where, data, {"kind", "variable", "days"})["days"])
    raise ConfigError(f"CONFIG: {where} has a predicate that does not fit")


def compile_config(data: dict) -> LinkagePlan:
    """The plan of a configuration; anything unknown, missing or unfit is an error."""
    _keys("configuration", data, {"schema_version", "mode", "datasets", "variables", "blocking", "comparisons"},
          {"constraint", "anchors", "policy", "pair_budget", "prior", "partitions"})
    if data["schema_version"] != "0.1":
        raise ConfigError("CONFIG: unknown schema version")
    if data["mode"] not in MODES or data.get("constraint", "one_to_one") not in CONSTRAINTS:
        raise ConfigError("CONFIG: unknown mode or constraint")
    variables, types = {}, {}
    for name, v in data["variables"].items():
        _keys(f"variable {name}", v, {"type"}, {"transforms"})
        if not _NAME.match(name) or v["type"] not in ("string", "categorical", "date", "integer", "float", "boolean"):
            raise ConfigError(f"CONFIG: variable {name} is not sound")
        steps = tuple(t if isinstance(t, str) else (next(iter(t)), next(iter(t.values()))) for t in v.get("transforms", []))
        if any((s if isinstance(s, str) else s[0]) not in TRANSFORMS for s in steps):
            raise ConfigError(f"CONFIG: variable {name} has an unknown transform")
        variables[name], types[name] = steps, v["type"]
    datasets = []
    for d in data["datasets"]:
        _keys("data set", d, {"id", "path", "format", "identity", "columns"})
        if d["format"] not in FORMATS or not _NAME.match(d["id"]) or not set(d["columns"]) <= set(variables):
            raise ConfigError(f"CONFIG: data set {d['id']} is not sound")
        datasets.append(Dataset(d["id"], d["path"], d["format"], d["identity"], tuple(d["columns"].items())))
    if len(datasets) != (1 if data["mode"] == "dedupe_only" else 2):
        raise ConfigError("CONFIG: number of data sets does not fit the mode")
    rules = {r: _predicate(f"rule {r}", p, types) for r, p in data["blocking"].items()}
    comparisons = []
    for c, v in data["comparisons"].items():
        _keys(f"comparison {c}", v, {"variable", "function", "levels"}, {"arguments"})
        levels = tuple((lv,) if isinstance(lv, str) else (next(iter(lv)), next(iter(lv.values()))) for lv in v["levels"])
        try:
            comparisons.append(Comparison(c, v["variable"], v["function"], levels, dict(v.get("arguments", {}))))
        except ValueError as wrong:
            raise ConfigError(f"CONFIG: comparison {c}: {wrong}") from None
    anchors = tuple(Anchor(a, _predicate(f"anchor {a}", v["predicate"], types), v.get("unique_left", True), v.get("unique_right", True)) for a, v in data.get("anchors", {}).items())
    fractions = data.get("partitions", {})
    if fractions and abs(sum(fractions.values()) - 1) > 1e-9:
        raise ConfigError("CONFIG: partition fractions must sum to 1")
    digest = hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
    return LinkagePlan(data["mode"], data.get("constraint", "one_to_one"), tuple(datasets), variables, rules, tuple(comparisons), anchors, Policy(**data.get("policy", {})),
                       int(data.get("pair_budget", 10_000_000)), float(data.get("prior", 0.01)), fractions, digest)
