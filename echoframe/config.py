"""Settings of the clone engine, and their JSON form."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from .errors import InvalidConfig

MODES = ("exact", "renamed", "nearMiss")

#: The extensions that a scan reads unless told otherwise.
DEFAULT_EXTENSIONS = (
    "rs", "go", "c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "sh", "bash", "zsh", "sql", "psql", "js", "jsx",
    "mjs", "cjs", "ts", "tsx", "mts", "cts", "py", "pyi", "java", "cs", "html", "htm", "xml", "vue", "svelte", "md", "mdx",
)


@dataclass(frozen=True)
class CloneConfig:
    mode: str = "nearMiss"
    min_tokens: int = 24
    k_gram: int = 8
    winnowing_window: int = 4
    min_similarity: int = 800
    candidate_similarity: int = 450
    min_shared_fingerprints: int = 2
    max_bucket_size: int = 128
    max_fragments: int = 1_000_000
    max_tokens_per_fragment: int = 100_000
    max_candidates: int = 5_000_000
    compare_overlapping_fragments: bool = False

    def validate(self) -> "CloneConfig":
        if self.mode not in MODES:
            raise InvalidConfig("mode", f"is none of {', '.join(MODES)}")
        for name in ("k_gram", "winnowing_window"):
            if getattr(self, name) < 1:
                raise InvalidConfig(name, "is below 1")
        if self.min_tokens < self.k_gram + self.winnowing_window - 1:
            raise InvalidConfig("min_tokens", "has no room for a window of k-grams")
        for name in ("min_similarity", "candidate_similarity"):
            if not 0 <= getattr(self, name) <= 1000:
                raise InvalidConfig(name, "is no share of 1000")
        if self.candidate_similarity > self.min_similarity:
            raise InvalidConfig("candidate_similarity", "lies above min_similarity")
        for name in ("min_shared_fingerprints", "max_bucket_size", "max_fragments", "max_tokens_per_fragment", "max_candidates"):
            if getattr(self, name) < 1:
                raise InvalidConfig(name, "is below 1")
        return self

    @property
    def stream(self) -> str:
        """Which token stream is fingerprinted."""
        return "strict" if self.mode == "exact" else "renamed"


@dataclass(frozen=True)
class RepositoryOptions:
    max_file_bytes: int = 1_500_000
    min_fragment_lines: int = 3
    max_fragment_lines: int = 400
    cross_extensions: bool = False
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS

    def with_extensions(self, names) -> "RepositoryOptions":
        return replace(self, extensions=tuple(sorted({n.strip().lstrip(".").lower() for n in names} - {""})))

    def validate(self) -> "RepositoryOptions":
        if self.max_file_bytes < 1:
            raise InvalidConfig("max_file_bytes", "is below 1")
        if self.min_fragment_lines < 1:
            raise InvalidConfig("min_fragment_lines", "is below 1")
        if self.max_fragment_lines < self.min_fragment_lines:
            raise InvalidConfig("max_fragment_lines", "lies below min_fragment_lines")
        if not self.extensions:
            raise InvalidConfig("extensions", "names no extension")
        return self


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def options_from_json(options: dict) -> tuple[CloneConfig, RepositoryOptions]:
    """Settings from a JSON object with camel-case names; unknown names, wrong
    kinds of values and values out of range are errors."""
    parts = []
    known = {}
    for kind in (CloneConfig, RepositoryOptions):
        known[kind] = {_camel(f.name): f for f in fields(kind)}
    unknown = set(options) - set(known[CloneConfig]) - set(known[RepositoryOptions])
    if unknown:
        raise InvalidConfig(sorted(unknown)[0], "is not known")
    for kind, names in known.items():
        values = {}
        for name, f in names.items():
            if options.get(name) is None:
                continue
            value, default = options[name], f.default
            if isinstance(default, tuple):
                if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
                    raise InvalidConfig(f.name, "takes a list of strings")
                value = RepositoryOptions().with_extensions(value).extensions
            elif type(value) is not type(default) or (type(value) is int and value < 0):
                raise InvalidConfig(f.name, "has a value of another kind")
            values[f.name] = value
        parts.append(kind(**values).validate())
    return parts[0], parts[1]
