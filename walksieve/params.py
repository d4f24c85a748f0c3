"""Settings of a walk, by section, and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

# --- fixed values ---------------------------------------------------------
# Order of the stages of a run.
STAGES = ("stitch", "gate", "faces", "embed", "calibrate", "select", "segment")

# The stage that a changed setting re-runs from, by settings section.
SECTION_STAGE = {
    "gate": "gate",
    "faces": "faces",
    "embed": "embed",
    "calib": "calibrate",
    "dedup": "select",
    "segment": "segment",
}

# Input size in pixels by backbone name.
BACKBONE_SIZE = {
    "vit_base_patch16_dinov3.lvd1689m": 384,
    "vit_small_patch16_dinov3.lvd1689m": 384,
    "vit_base_patch14_dinov2.lvd142m": 392,
    "vit_base_patch16_clip_384.laion2b_ft_in12k_in1k": 384,
}

# Segmentation models: "semantic" labels every pixel, "open" takes class names.
SEGMENTER_KIND = {
    "facebook/mask2former-swin-large-ade-semantic": "semantic",
    "shi-labs/oneformer_ade20k_swin_large": "semantic",
    "nvidia/segformer-b4-finetuned-ade-512-512": "semantic",
    "nvidia/segformer-b0-finetuned-ade-512-512": "semantic",
    "IDEA-Research/grounding-dino-base": "open",
}

# Class names that open-vocabulary models look for by default.
SITE_CLASSES = (
    "rebar", "formwork", "scaffolding", "concrete column", "concrete beam",
    "concrete slab", "block wall", "electrical conduit", "pipe", "duct",
    "window opening", "door opening", "staircase", "debris", "plaster",
)

# Review actions.
ACTIONS = ("pick", "drop", "restore")

# Descriptive columns of a walk.
META_FIELDS = (
    "site", "building", "floor", "stage", "operator", "mount_height_cm",
    "shot_date", "shot_time", "camera",
)

MIN_FAR_PAIRS = 50          # fewer far pairs give no threshold
SKETCH_SIZE = 5000          # cosines kept in a calibration record
HEALTHY_REFERENCE = 0.95    # a lower reference median is suspect
MIN_SHARE = 0.01            # smaller class shares are not reported
MIN_MARGIN = 0.05           # lead over the runner-up that names a detection
BORDERLINE_MARGIN = 0.015   # members this close above tau are flagged
RUNS_KEPT = 20              # run lines kept per walk
CLASSES_SHOWN = 6           # classes in a mix or an export row
THUMB_WIDTH = 256           # the one thumbnail width
MIN_JPEG_BYTES = 128        # shorter files are torn
MAX_PROMPT_CLASSES = 40     # longer prompts are refused
# --- end of fixed values --------------------------------------------------


@dataclass(frozen=True)
class Extract:
    fps: float = 2.0
    pano_width: int = 3840


@dataclass(frozen=True)
class Faces:
    fov_deg: float = 110.0
    size: int = 1024
    yaws: tuple[int, ...] = (45, 135, 225, 315)


@dataclass(frozen=True)
class Gate:
    dead: float = 0.15
    band: tuple[float, float] = (0.25, 0.75)


@dataclass(frozen=True)
class Embed:
    model_name: str = "vit_base_patch16_dinov3.lvd1689m"
    batch_size: int = 8

    @property
    def img_size(self) -> int:
        return BACKBONE_SIZE.get(self.model_name, 384)


@dataclass(frozen=True)
class Calib:
    samples: int = 10
    far_seconds: float = 20.0
    false_merge_pct: float = 5.0


@dataclass(frozen=True)
class Dedup:
    tau: float = 0.94
    rule: str = "calibrated"
    solo_floor: float = 0.50
    solo_span: float = 45.0


@dataclass(frozen=True)
class Segment:
    enabled: bool = False
    model_name: str = "facebook/mask2former-swin-large-ade-semantic"
    classes: tuple[str, ...] = SITE_CLASSES
    threshold: float = 0.2


@dataclass(frozen=True)
class WalkParams:
    extract: Extract = field(default_factory=Extract)
    faces: Faces = field(default_factory=Faces)
    gate: Gate = field(default_factory=Gate)
    embed: Embed = field(default_factory=Embed)
    calib: Calib = field(default_factory=Calib)
    dedup: Dedup = field(default_factory=Dedup)
    segment: Segment = field(default_factory=Segment)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, saved: dict) -> "WalkParams":
        """Settings read back from JSON; missing sections take their defaults."""
        built = {}
        for f in fields(cls):
            values = {k: tuple(v) if isinstance(v, list) else v
                      for k, v in (saved.get(f.name) or {}).items()}
            built[f.name] = f.default_factory(**values)
        return cls(**built)
