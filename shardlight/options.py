"""Options of a carving run, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.catalogue import FORMATS, Format, linear


@dataclass(frozen=True)
class CarveOptions:
    """``formats``: names to look for, all where None. ``custom``: rows (extension, header, footer) that are always looked for.

    ``compat`` keeps the cursor rules of a sequential carver: only the best format is tried at a place, scanning goes on at the next
    cluster after a file, and clusters that a gap jump passes over aren't searched. ``max_file_bytes`` ends a file that grows
    beyond it as incomplete; None means no bound.
    """

    cluster_size: int = 4096
    workers: int = 1
    formats: tuple[str, ...] | None = None
    custom: tuple[tuple[str, bytes, bytes], ...] = ()
    max_search_clusters: int = 1000
    text_density: float = 0.8
    compat: bool = False
    max_file_bytes: int | None = None
    extra: tuple[Format, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.cluster_size <= 0:
            raise ValueError("cluster_size must be positive")
        if self.workers < 1:
            raise ValueError("workers must be 1 or more")
        if self.max_search_clusters <= 0:
            raise ValueError("max_search_clusters must be positive")
        if not 0 <= self.text_density <= 1:
            raise ValueError("text_density lies between 0 and 1")
        if self.formats is not None and not self.active():
            raise ValueError(f"none of these formats is known: {', '.join(self.formats)}")

    def unknown(self) -> list[str]:
        """Requested names that no format has; they are left out."""
        return [n for n in self.names() if n not in FORMATS]

    def names(self) -> list[str]:
        return [] if self.formats is None else list(dict.fromkeys(n.strip().lower() for n in self.formats if n.strip()))

    def active(self) -> list[Format]:
        """Formats in order of priority; aliases stand for the same one, custom and extra formats come last."""
        chosen = FORMATS.values() if self.formats is None else [FORMATS[n] for n in self.names() if n in FORMATS]
        return [*{f.name: f for f in chosen}.values(), *(linear(*c) for c in self.custom), *self.extra]
