"""Sample arithmetic of whole frames on numpy arrays: modality and VOI transforms, colour, display."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from voxelake.codec import frames as fr
from voxelake.codec.dataset import Reader, values_of
from voxelake.dictionary import NATIVE

ROWS, COLUMNS, SAMPLES, BITS, STORED, REPRESENTATION, FRAMES, PHOTOMETRIC, PLANAR = (
    0x00280010, 0x00280011, 0x00280002, 0x00280100, 0x00280101, 0x00280103, 0x00280008, 0x00280004, 0x00280006,
)
CENTRE, WIDTH, INTERCEPT, SLOPE, FUNCTION, SHAPE = 0x00281050, 0x00281051, 0x00281052, 0x00281053, 0x00281056, 0x20500020
MODALITY_LUT, VOI_LUT, LUT_DESCRIPTOR, LUT_DATA = 0x00283000, 0x00283010, 0x00283002, 0x00283006
PIXELS, OFFSETS, LENGTHS = 0x7FE00010, 0x7FE00001, 0x7FE00002
REQUIRED = {ROWS: "Rows", COLUMNS: "Columns", SAMPLES: "SamplesPerPixel", BITS: "BitsAllocated"}
#: All that an image is described by, for a reader that skips the rest.
TAGS = frozenset((*REQUIRED, STORED, REPRESENTATION, FRAMES, PHOTOMETRIC, PLANAR, CENTRE, WIDTH, INTERCEPT, SLOPE, FUNCTION, SHAPE, MODALITY_LUT, VOI_LUT, LUT_DESCRIPTOR, LUT_DATA, PIXELS, OFFSETS, LENGTHS))


@dataclass
class Lut:
    """A lookup table: its entries, the value of the first, the bits of its output."""

    first: int
    entries: np.ndarray
    bits: int

    def of(self, v: np.ndarray) -> np.ndarray:
        if not len(self.entries):
            raise ValueError("the lookup table is empty")
        return self.entries[np.clip(np.trunc(v).astype(np.int64) - self.first, 0, len(self.entries) - 1)].astype(np.float64)


@dataclass
class Image:
    """What the pixel data of a dataset are, and how they are to be shown."""

    syntax: str
    rows: int = 0
    columns: int = 0
    samples: int = 0
    bits: int = 0
    stored: int = 0
    signed: bool = False
    n_frames: int = 1
    photometric: str = ""
    planar: int = 0
    little: bool = True
    data: bytes | None = None
    table: tuple | None = None
    slope: float | None = None
    intercept: float | None = None
    centres: list = field(default_factory=list)
    widths: list = field(default_factory=list)
    function: str = ""
    shape: str = ""
    modality: Lut | None = None
    voi: list = field(default_factory=list)
    missing: list = field(default_factory=list)

    @property
    def sample_bytes(self) -> int:
        return max(self.bits // 8, 1)

    @property
    def frame_bytes(self) -> int:
        """Bytes of a native frame as it is stored; 4:2:2 keeps two bytes a pixel instead of three."""
        each = 2 if self.photometric == "YBR_FULL_422" and self.syntax in NATIVE else self.samples
        return self.rows * self.columns * each * self.sample_bytes

    @property
    def monochrome(self) -> bool:
        return self.photometric in ("MONOCHROME1", "MONOCHROME2")


def describe(r: Reader, syntax: str) -> Image:
    """The image of a parsed dataset; `missing` names what it lacks."""
    top = {e.tag: e for e in r.elements if not e.path}
    deep: dict[tuple, dict] = {}
    for e in r.elements:
        if len(e.path) == 1 and e.path[0][0] in (MODALITY_LUT, VOI_LUT):
            deep.setdefault(e.path[0], {})[e.tag] = e

    def texts(tag: int) -> list[str]:
        e = top.get(tag)
        try:
            return [] if e is None else [v for v in values_of(e.vr, e.raw, r.little) or [] if v != ""]
        except (ValueError, LookupError):
            return []

    def numbers(tag: int, kind: type) -> list:
        try:
            return [kind(v) for v in texts(tag)]
        except ValueError:
            return []

    one = lambda tag, kind, default=None: next(iter(numbers(tag, kind)), default)
    img = Image(syntax, little=r.little, missing=[name for t, name in REQUIRED.items() if one(t, int) is None])
    img.rows, img.columns, img.samples, img.bits = (one(t, int, 0) for t in REQUIRED)
    img.stored, img.signed, img.n_frames = one(STORED, int, img.bits), bool(one(REPRESENTATION, int, 0)), max(one(FRAMES, int, 1), 1)
    img.photometric, img.planar = "".join(texts(PHOTOMETRIC)[:1]).strip(), one(PLANAR, int, 0)
    img.slope, img.intercept, img.centres, img.widths = one(SLOPE, float), one(INTERCEPT, float), numbers(CENTRE, float), numbers(WIDTH, float)
    img.function, img.shape = ("".join(texts(t)[:1]).strip().upper() for t in (FUNCTION, SHAPE))
    raw = lambda t: top[t].raw if t in top else None
    img.data, img.table = raw(PIXELS), fr.extended_table(raw(OFFSETS), raw(LENGTHS))
    if img.data is None:
        img.missing.append("PixelData")
    for step in sorted(deep):
        lut = read_lut(deep[step], r.little, img.signed)
        if step[0] == VOI_LUT:
            img.voi.append(lut)
        elif step[1] == 0:
            img.modality = lut
    return img


def read_lut(item: dict, little: bool, signed: bool) -> Lut | None:
    """The table of an item, None where it has none. 0 entries stand for 65,536; bytes that are too
    short for words are entries of one byte."""
    if LUT_DESCRIPTOR not in item or LUT_DATA not in item:
        return None
    order = "<" if little else ">"
    head = item[LUT_DESCRIPTOR].raw or b""
    if len(head) < 6:
        raise ValueError("the LUT descriptor has fewer than three values")
    n, _, bits = (int(x) for x in np.frombuffer(head[:6], f"{order}u2"))
    first = int(np.frombuffer(head[2:4], f"{order}{'i' if signed else 'u'}2")[0])
    n, body = n or 65536, item[LUT_DATA].raw or b""
    if len(body) >= 2 * n:
        return Lut(first, np.frombuffer(body[: 2 * n], f"{order}u2"), bits)
    if len(body) >= n:
        return Lut(first, np.frombuffer(body[:n], np.uint8), bits)
    raise ValueError(f"the LUT data hold {len(body)} bytes for {n} entries")


def stored_frame(img: Image, index: int) -> bytes:
    """One frame as it is stored. Native data are frames and at most one byte of padding."""
    if index < 0 or index >= img.n_frames:
        raise ValueError(f"there is no frame {index} of {img.n_frames}")
    if img.missing:
        raise ValueError("missing " + ", ".join(img.missing))
    if img.syntax in NATIVE:
        size = img.frame_bytes
        if not 0 <= len(img.data) - size * img.n_frames <= 1:
            raise ValueError(f"{len(img.data)} bytes of pixel data instead of {size * img.n_frames}")
        return img.data[index * size : (index + 1) * size]
    return fr.single_frame(img.data, index, img.n_frames, img.table)


def decoded_frame(img: Image, index: int, raw: bool, codecs: dict) -> bytes:
    """One frame decoded; unless `raw`, colours as interleaved RGB."""
    frame = stored_frame(img, index)
    if img.syntax not in NATIVE:
        frame = fr.decode_frame(img.syntax, frame, img.rows, img.columns, img.samples, img.bits, codecs)
    return frame if raw else coloured(frame, img)


def coloured(frame: bytes, img: Image) -> bytes:
    """4:2:2 expanded, planes interleaved, YBR_FULL as RGB (8 bit)."""
    kind = img.photometric
    if kind == "YBR_FULL_422" and img.syntax in NATIVE:
        frame, kind = expand_422(frame), "YBR_FULL"
    elif img.samples > 1 and img.planar == 1 and img.syntax in NATIVE:
        frame = fr.interleave(frame, img.samples, img.sample_bytes)
    return rgb_of(frame) if kind in ("YBR_FULL", "YBR_FULL_422") and img.bits == 8 and img.samples == 3 else frame


def expand_422(frame: bytes) -> bytes:
    """YBR_FULL_422 (two luminances for one pair of colour differences, 8 bit) to full pixels."""
    if len(frame) % 4:
        raise ValueError("4:2:2 data comes in fours")
    x = np.frombuffer(frame, np.uint8).reshape(-1, 4)
    return np.stack([x[:, 0], x[:, 2], x[:, 3], x[:, 1], x[:, 2], x[:, 3]], 1).tobytes()


def to_bytes(v: np.ndarray) -> bytes:
    """Rounded halves up, held to 0 to 255."""
    return np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8).tobytes()


def rgb_of(frame: bytes) -> bytes:
    """YBR_FULL pixels as RGB."""
    if len(frame) % 3:
        raise ValueError("the frame holds no whole number of pixels")
    y, cb, cr = np.frombuffer(frame, np.uint8).reshape(-1, 3).astype(np.float64).T
    cb, cr = cb - 128, cr - 128
    return to_bytes(np.stack([y + 1.402 * cr, y - 0.114 * 1.772 / 0.587 * cb - 0.299 * 1.402 / 0.587 * cr, y + 1.772 * cb], 1).ravel())


def modality_values(v: np.ndarray, img: Image) -> np.ndarray:
    """By the modality table, else by slope and intercept where both are there."""
    if img.modality is not None:
        return img.modality.of(v)
    return v if img.slope is None or img.intercept is None else v * img.slope + img.intercept


def window_range(img: Image) -> tuple[float, float]:
    """Least and greatest value that a window maps to."""
    if img.modality is not None:
        return 0.0, 2.0 ** (img.modality.bits or 16) - 1
    low = -(2.0 ** (img.stored - 1)) if img.signed else 0.0
    high = low + 2.0**img.stored - 1
    if img.slope is not None and img.intercept is not None:
        low, high = low * img.slope + img.intercept, high * img.slope + img.intercept
    return low, high


def windowed(v: np.ndarray, centre: float, width: float, img: Image) -> np.ndarray:
    """By window centre and width under the VOI function."""
    if not img.monochrome:
        raise ValueError("only monochrome images have windows")
    function = img.function or "LINEAR"
    if function not in ("LINEAR", "LINEAR_EXACT", "SIGMOID"):
        raise ValueError(f"unknown VOI LUT function {function}")
    if width < 1 if function == "LINEAR" else width <= 0:
        raise ValueError(f"a window of width {width} under {function}")
    low, high = window_range(img)
    if function == "SIGMOID":
        return (high - low) / (1 + np.exp(-4 * (v - centre) / width)) + low
    c, w = (centre - 0.5, width - 1) if function == "LINEAR" else (centre, width)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = ((v - c) / w + 0.5) * (high - low) + low
    return np.where(v <= c - w / 2, low, np.where(v > c + w / 2, high, inner))


def voi_values(v: np.ndarray, img: Image, index: int = 0, prefer_lut: bool = True) -> np.ndarray:
    """By the VOI table or window `index`; where there are both, by the one preferred."""
    lut = None
    if img.voi:
        if index >= len(img.voi):
            raise ValueError(f"there is no VOI table {index}")
        lut = img.voi[index]
    if img.centres and img.widths and (lut is None or not prefer_lut):
        if index >= min(len(img.centres), len(img.widths)):
            raise ValueError(f"there is no window {index}")
        return windowed(v, img.centres[index], img.widths[index], img)
    return v if lut is None else lut.of(v)


def shaped(v: np.ndarray, shape: str) -> np.ndarray:
    """By the presentation LUT shape."""
    if shape in ("", "IDENTITY"):
        return v
    if shape != "INVERSE":
        raise ValueError(f"unknown presentation LUT shape {shape}")
    return v.max() - v


def packed(v: np.ndarray) -> bytes:
    """8 bits for display: as they are within 0 to 255, zeros if constant, else stretched."""
    if not v.size:
        return b""
    low, high = v.min(), v.max()
    if high <= low:
        return bytes(v.size)
    return to_bytes(v if low >= 0 and high <= 255 else (v - low) * (255.0 / (high - low)))


def is_plain_colour(img: Image) -> bool:
    """8-bit colour that nothing is to be done to but bringing it to RGB."""
    asked = img.slope is not None or img.intercept is not None or img.modality or img.voi or img.centres or img.widths or img.shape not in ("", "IDENTITY")
    return img.bits == 8 and img.samples >= 3 and not asked


def display_frame(img: Image, index: int, codecs: dict, window: int = 0, prefer_lut: bool = True) -> bytes:
    """One frame as 8-bit samples to be shown: modality, VOI, presentation shape, MONOCHROME1 inverted."""
    if is_plain_colour(img):
        return decoded_frame(img, index, False, codecs)
    v = fr.unpack_samples(decoded_frame(img, index, True, codecs), img.bits, img.signed, img.little)
    v = shaped(voi_values(modality_values(v, img), img, window, prefer_lut), img.shape)
    return packed(v.max() - v if img.photometric == "MONOCHROME1" and v.size else v)
