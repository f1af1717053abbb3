"""Configuration: files with sections and includes, and parameter strings of clustering."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

METHODS = ("gac", "multipass_gac", "agglomerative", "kmeans", "kmeans_hclust", "growseed")
#: Named in the interface this follows, implemented nowhere.
UNIMPLEMENTED = ("tight", "spectral", "xmeans", "annealing", "buckshot")
REPRESENTATIVES = ("centroid", "nearest", "average", "rms", "furthest")


def _named(text: str, names: tuple[str, ...]) -> str:
    """The name that an unambiguous beginning stands for."""
    key = text.strip().lower().replace("-", "_")
    if key in names:
        return key
    found = [n for n in names if n.startswith(key)]
    if len(found) != 1:
        raise ValueError(f"{text!r} is {'ambiguous' if found else 'unknown'}")
    return found[0]


@dataclass(frozen=True)
class ClusterParameters:
    method: str = "gac"
    rep: str = "centroid"
    measure: str = "cosine"
    threshold: float = 1.0
    clusters: int = 10
    iterations: int = 10
    backoff: float = 0.1
    hard_limit: bool = True
    alpha: float = 0.5
    beta: float = 0.5

    @classmethod
    def parse(cls, text: str) -> ClusterParameters:
        """From ``method=kmeans,measure=cos,clusters=20``; keys and names may be cut short where that is unambiguous."""
        from ..functions.similarity import measure_name

        out, kinds = cls(), {f.name: f.type for f in fields(cls)}
        for part in filter(None, (p.strip() for p in text.split(","))):
            key, _, value = part.partition("=")
            key = _named(key, tuple(kinds))
            if key == "method":
                name = _named(value, METHODS + UNIMPLEMENTED)
                if name in UNIMPLEMENTED:
                    raise NotImplementedError(f"clustering method {name}")
                made = name
            elif key == "rep":
                made = _named(value, REPRESENTATIVES)
            elif key == "measure":
                made = measure_name(value)
            elif key == "hard_limit":
                made = value.strip().lower() in ("1", "t", "true", "yes", "on")
            else:
                made = (int if kinds[key] == "int" else float)(value)
            out = replace(out, **{key: made})
        return out


#: Readers of setting types.
TYPES = {
    "integer": int, "cardinal": lambda v: max(0, int(v)), "real": float, "boolean": lambda v: v.strip().lower() in ("1", "t", "true", "yes", "on"), "string": lambda v: v.strip().strip('"'),
    "filename": lambda v: os.path.expanduser(v.strip().strip('"')), "symbol": lambda v: v.strip().upper(), "list": str.split, "symlist": lambda v: v.upper().split(), "keyword": lambda v: v.strip().lower(),
    "bitflags": lambda v: frozenset(v.lower().split("+")), "assoclist": lambda v: dict(p.split("=", 1) for p in v.split()), "basedir": lambda v: v.strip().rstrip("/"), "encoding": lambda v: v.strip().lower(),
}


@dataclass
class Settings:
    """Sections of ``key: value`` or ``key = value`` lines; ``include FILE`` reads another file in place, ";" and "#" start comments."""

    kinds: dict[str, str] = field(default_factory=dict)
    values: dict[str, dict[str, object]] = field(default_factory=dict)

    def load(self, path: str, section: str = "") -> Settings:
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.strip()
                if not line or line[0] in ";#":
                    continue
                if line.startswith("[") and line.endswith("]"):
                    section = line[1:-1].strip().lower()
                elif line.lower().startswith("include "):
                    self.load(os.path.join(os.path.dirname(path), line.split(None, 1)[1].strip('"')), section)
                else:
                    key, _, value = line.partition(":") if ":" in line.split("=")[0] else line.partition("=")
                    self.set(key, value, section)
        return self

    def set(self, key: str, value: str, section: str = "") -> None:
        key = key.strip().lower()
        self.values.setdefault(section, {})[key] = TYPES[self.kinds.get(key, "string")](value)

    def get(self, key: str, section: str = "", default=None):
        return self.values.get(section, {}).get(key.lower(), default)

    def describe(self) -> list[tuple[str, str, str, str]]:
        """(section, key, type, value), sorted."""
        return sorted((s, k, self.kinds.get(k, "string"), str(v)) for s, kv in self.values.items() for k, v in kv.items())

    def apply(self, spark) -> None:
        """Settings of section [spark] to the session."""
        for k, v in self.values.get("spark", {}).items():
            spark.conf.set(k, str(v))
