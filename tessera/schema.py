"""Parameters of the simulation and their presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Fixed values of the presets: marker genes, marker effect, overlap effect, field intensity, field range, random noise, dropout range,
#: dispersion range, cell noise.
PRESETS = {
    "easy": (10, 2.0, 0.0, 0.5, 50.0, 0.1, (0.1, 0.3), (3.0, 1.5), 0.1),
    "medium": (7, 1.2, 0.2, 1.0, 30.0, 0.2, (0.2, 0.5), (2.0, 1.0), 0.2),
    "hard": (5, 0.8, 0.4, 1.5, 15.0, 0.4, (0.3, 0.7), (1.5, 0.8), 0.3),
    "legacy": (10, 2.0, 0.0, 0.5, 50.0, 0.0, (0.1, 0.5), (5.0, 0.5), 0.0),
}


@dataclass(frozen=True)
class Params:
    """None means: as the preset of the difficulty says."""

    n_cells: int = 20_000
    n_genes: int = 100
    k: int = 5
    threshold: float = 0.7
    seed: int = 123
    difficulty: str = "hard"
    spatial: bool = True
    markers: int | None = None
    marker_effect: float | None = None
    overlap_effect: float | None = None
    noise_intensity: float | None = None
    noise_range: float | None = None
    random_sd: float | None = None
    dropout: tuple[float, float] | None = None
    dispersion: tuple[float, float] | None = None
    cell_sd: float | None = None
    hybrids: bool = True
    max_pairs: int = 1000
    hybrid_weight: tuple[float, float] = (0.2, 0.5)
    stable_mean_mode: str = "reference"

    def resolved(self) -> Params:
        if self.difficulty not in PRESETS:
            raise ValueError(f"difficulty must be one of {sorted(PRESETS)}")
        names = ("markers", "marker_effect", "overlap_effect", "noise_intensity", "noise_range", "random_sd", "dropout", "dispersion", "cell_sd")
        own = {n: v for n, v in zip(names, PRESETS[self.difficulty], strict=True) if getattr(self, n) is None}
        if self.difficulty == "legacy":
            own["hybrids"] = False
        return replace(self, **own)

    def row(self) -> dict:
        return {f.name: list(v) if isinstance(v := getattr(self, f.name), tuple) else v for f in fields(self)}
