"""Parameters of all stages with their defaults, and the domains of their names."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Short codes of segmentation algorithms.
ALGORITHMS = {"MorphologyIteration1": "MI1", "MorphologyIteration2": "MI2", "LineSegmentation": "LS", "MSER": "MSER", "MajorVoting": "MV"}
APPROXIMATIONS = ("Contour", "Brect", "Rrect", "Hull", "HullApproximated")
DATABASES = ("enrollment", "recognition")
ALIGNMENTS = ("NoAlignment", "Reference", "ToCorners")
MODELS = ("Triplet", "Resnet50", "Siamese", "SimCLR", "Hash")
DESCRIPTORS = ("AKAZE", "SIFT", "ORB", "BRISK", "KAZE")


@dataclass(frozen=True)
class Loading:
    """Which images are processed and in which order."""

    database: str = "enrollment"
    filter_by: dict = field(default_factory=dict)
    filter_mode: str = "inclusive"
    fraction: float = 1.0
    sort_by: tuple[str, ...] = ("packageclass", "phone")
    group_by: tuple[str, ...] = ()
    shuffle: bool = False
    seed: int = 666
    chunk: int = 5000


@dataclass(frozen=True)
class Search:
    """Descriptor search and ranking."""

    algorithms: tuple[str, ...] = ("MSER", "MI1")
    base_model: str = "resnet18"
    descriptor_length: int = 256
    neighbours: int = 15
    top_neighbours: int = 9
    top_ranked: int = 10
    hash_bits: int = 128
    coarse_clusters: int = 16
    subvectors: int = 16
    subquantizer_clusters: int = 512


@dataclass(frozen=True)
class FineMatching:
    """Keypoint matching of candidates."""

    algorithms: tuple[str, ...] = ("MSER", "MI1")
    descriptor: str = "AKAZE"
    descriptors: tuple[str, ...] = ("AKAZE", "SIFT", "ORB")
    ratio: float = 0.7
    tolerance: float = 3.0


@dataclass(frozen=True)
class Evaluation:
    """Which scores are taken against annotations and stored verifications."""

    scale: float = 1.0
    annotation_mask: bool = True
    annotation_regions: bool = True
    verification_mask: bool = True
    verification_regions: bool = True
    raise_on_bad_quality: bool = False


@dataclass(frozen=True)
class Losses:
    """Contrastive training losses."""

    batch_size: int = 128
    temperature: float = 0.5
    use_cosine: bool = True
