"""Settings of the pipeline. Fixed values are the published defaults of the routing and matching rules."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Preprocess:
    max_side: int = 1600
    min_side: int = 1000
    upscale: bool = True
    denoise: bool = False
    normalize_illumination: bool = True
    background_kernel: int = 31


@dataclass(frozen=True)
class Binarize:
    method: str = "adaptive_gaussian"
    block_size: int = 35
    c: float = 10.0
    sauvola_window: int = 25
    sauvola_k: float = 0.2
    recover_inverted: bool = True
    inverted_min_area_frac: float = 0.002
    inverted_min_fill: float = 0.55
    most_recovered: int = 8


@dataclass(frozen=True)
class Label:
    connectivity: int = 8


@dataclass(frozen=True)
class Route:
    min_pixel_area: int = 4
    min_side: int = 2
    oversized_frac: float = 0.60
    hollow_fill: float = 0.15
    rule_fill: float = 0.40
    oversized_rule_aspect: float = 8.0
    horizontal_aspect: float = 12.0
    vertical_aspect: float = 0.03
    relative: bool = True
    least_text: int = 12
    dense_area_frac: float = 0.02
    over_median: float = 4.0
    under_median: float = 0.30
    normal_median: float = 0.60
    diacritic_median: float = 0.55
    parent_x_overlap: float = 0.30
    parent_gap: float = 1.20
    cap_quantile: float = 0.95


@dataclass(frozen=True)
class Match:
    iou: float = 0.5
    cover: float = 0.5
    fragment: float = 0.5
    junk: float = 0.30
    small: float = 0.55
    nontext: float = 0.5
    inside: float = 0.5
    straddle: float = 0.15


@dataclass(frozen=True)
class Settings:
    preprocess: Preprocess = field(default_factory=Preprocess)
    binarize: Binarize = field(default_factory=Binarize)
    label: Label = field(default_factory=Label)
    route: Route = field(default_factory=Route)

    @classmethod
    def from_dict(cls, given: dict | None) -> Settings:
        """Sections that are missing keep their defaults; an unknown key is a TypeError."""
        given = dict(given or {})
        parts = {f.name: f.default_factory(**given.pop(f.name)) if f.name in given else f.default_factory() for f in fields(cls)}
        if given:
            raise TypeError(f"unknown sections: {sorted(given)}")
        return cls(**parts)


@dataclass(frozen=True)
class RunFilter:
    """Empty tuples don't filter; limit counts samples that are processed."""

    sources: tuple[str, ...] = ()
    captures: tuple[str, ...] = ()
    scripts: tuple[str, ...] = ()
    limit: int | None = None
