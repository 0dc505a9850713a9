"""Settings: defaults, then a TOML file, then environment variables; all validated."""

from __future__ import annotations

import dataclasses
import os
import re
import tomllib
import unicodedata
import warnings
from dataclasses import dataclass, field
from typing import Any

#: Prefix of the environment variables, and what separates the levels in their names.
ENV_PREFIX, ENV_LEVELS = "LEXQUARRY_", "__"


class ConfigError(ValueError):
    """A setting is missing, misspelt or out of range."""


@dataclass(frozen=True)
class Normalization:
    unicode_normalization: str | None = None
    diacritic_folding_enabled: bool = False
    stemming_enabled: bool = False

    def __post_init__(self):
        if self.unicode_normalization not in (None, "nfc", "nfkc"):
            raise ConfigError(f"unicode_normalization: {self.unicode_normalization!r} is none of none, nfc, nfkc")


@dataclass(frozen=True)
class Tokenization:
    detect_special_patterns: bool = True
    compat_split_special_patterns: bool = True


@dataclass(frozen=True)
class Stopwords:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("allow", "deny"):
            object.__setattr__(self, name, tuple(unicodedata.normalize("NFKD", w) for w in getattr(self, name)))
        if both := set(self.allow) & set(self.deny):
            raise ConfigError(f"stopwords: {sorted(both)} are both allowed and denied")


@dataclass(frozen=True)
class Search:
    query_limit_default: int = 10
    query_limit_maximum: int = 100
    query_alternates_try: int = 4
    query_minimum_term_idf: float = 0.1
    query_minimum_term_idf_minimum_object_count: int = 100
    suggest_limit_default: int = 5
    suggest_limit_maximum: int = 20
    list_limit_default: int = 100
    list_limit_maximum: int = 500
    prefix_matching_enabled: bool = True
    fuzzy_matching_enabled: bool = True
    #: How the scores of one document and term are merged: min (as the reference does) or max.
    merge: str = "min"
    #: Query terms also match their NFC and NFD forms (only without unicode_normalization).
    match_normal_forms: bool = True

    def __post_init__(self):
        for kind in ("query", "suggest", "list"):
            if not 1 <= getattr(self, f"{kind}_limit_default") <= getattr(self, f"{kind}_limit_maximum"):
                raise ConfigError(f"search: the default {kind} limit is out of its bounds")
        if self.merge not in ("min", "max"):
            raise ConfigError("search: merge is min or max")


@dataclass(frozen=True)
class Store:
    path: str = "./data/store"
    retain_word_objects: int = 1000
    kv_inactive_after: int = 1800
    kv_flush_after: int = 900
    fst_inactive_after: int = 300
    consolidate_after: int = 180
    max_words: int = 250_000

    def __post_init__(self):
        if self.kv_flush_after >= self.kv_inactive_after:
            raise ConfigError("store.kv: flush_after must be below inactive_after")
        if self.consolidate_after >= self.fst_inactive_after:
            raise ConfigError("store.fst: consolidate_after must be below inactive_after")
        if self.retain_word_objects < 1 or self.max_words < 1:
            raise ConfigError("store: retention and word limits are at least 1")


@dataclass(frozen=True)
class Config:
    normalization: Normalization = field(default_factory=Normalization)
    tokenization: Tokenization = field(default_factory=Tokenization)
    stopwords: Stopwords = field(default_factory=Stopwords)
    search: Search = field(default_factory=Search)
    store: Store = field(default_factory=Store)

    def with_(self, **groups: dict[str, Any]) -> Config:
        """A copy with single settings changed: ``config.with_(search={"query_alternates_try": 0})``."""
        return dataclasses.replace(self, **{g: dataclasses.replace(getattr(self, g), **values) for g, values in groups.items()})


#: Where a setting of the file goes, by its dotted name.
_PLACES = {
    "normalization.unicode_normalization": ("normalization", "unicode_normalization"),
    "normalization.diacritic_folding_enabled": ("normalization", "diacritic_folding_enabled"),
    "normalization.stemming_enabled": ("normalization", "stemming_enabled"),
    "tokenization.detect_special_patterns": ("tokenization", "detect_special_patterns"),
    "tokenization.compat_split_special_patterns": ("tokenization", "compat_split_special_patterns"),
    "stopwords.allow": ("stopwords", "allow"),
    "stopwords.deny": ("stopwords", "deny"),
    "store.kv.path": ("store", "path"),
    "store.kv.retain_word_objects": ("store", "retain_word_objects"),
    "store.kv.pool.inactive_after": ("store", "kv_inactive_after"),
    "store.kv.database.flush_after": ("store", "kv_flush_after"),
    "store.fst.pool.inactive_after": ("store", "fst_inactive_after"),
    "store.fst.graph.consolidate_after": ("store", "consolidate_after"),
    "store.fst.graph.max_words": ("store", "max_words"),
} | {f"search.{f.name}": ("search", f.name) for f in dataclasses.fields(Search)}


def _flat(tree: dict, prefix: str = "") -> dict[str, Any]:
    out = {}
    for k, v in tree.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def _database_rules(flat: dict[str, Any]) -> None:
    get = lambda k: flat.get(f"store.kv.database.{k}")
    if get("write_buffer") == 0:
        raise ConfigError("store.kv.database.write_buffer must not be 0")
    if get("max_flushes") is not None and get("max_background_jobs") is not None:
        raise ConfigError("store.kv.database: give either max_flushes or max_background_jobs")


def load(text: str = "", env: dict[str, str] | None = None) -> Config:
    """Settings from TOML text and the environment.

    ``${env.NAME}`` in a string stands for an environment variable; ``LEXQUARRY_SEARCH__QUERY_LIMIT_DEFAULT=20`` sets one
    key.  A ``channel.search`` table, from older files, overrides ``search``.  Knobs of storage engines are accepted and
    ignored with a warning, as are keys of network servers.
    """
    env = dict(os.environ if env is None else env)

    def fill(v):
        if isinstance(v, str):
            return re.sub(r"\$\{env\.([A-Za-z0-9_]+)\}", lambda m: env[m[1]] if m[1] in env else _missing(m[1]), v)
        return [fill(x) for x in v] if isinstance(v, list) else v

    flat = {k: fill(v) for k, v in _flat(tomllib.loads(text)).items()}
    flat |= {f"search.{k.removeprefix('channel.search.')}": v for k, v in flat.items() if k.startswith("channel.search.")}
    for name, value in env.items():
        if name.startswith(ENV_PREFIX):
            key = name.removeprefix(ENV_PREFIX).lower().replace(ENV_LEVELS, ".")
            try:
                flat[key] = tomllib.loads(f"v = {value}")["v"]
            except tomllib.TOMLDecodeError:
                flat[key] = value
    _database_rules(flat)
    groups: dict[str, dict[str, Any]] = {}
    for key, value in flat.items():
        if key in _PLACES:
            group, name = _PLACES[key]
            if name == "unicode_normalization" and isinstance(value, str):
                value = None if value.lower() == "none" else value.lower()
            groups.setdefault(group, {})[name] = tuple(value) if isinstance(value, list) else value
        elif not key.startswith(("channel.", "server.", "store.")):
            raise ConfigError(f"unknown setting {key}")
        elif key.startswith("store."):
            warnings.warn(f"{key} has no effect here", stacklevel=2)
    return Config().with_(**groups)


def _missing(name: str) -> str:
    raise ConfigError(f"environment variable {name} is not set")
