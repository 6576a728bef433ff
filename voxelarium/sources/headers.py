"""Headers of NIfTI-1, NIfTI-2 and ANALYZE files: bytes to records and back, and header extensions."""

from __future__ import annotations

import math
import re
import struct
import urllib.parse
import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass, field

import numpy as np

from ..functions.affine import affine_of, from_matvec, quaternion_of, voxel_sizes
from ..space import Space

#: Codes of the format's data types (fixed values).
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {name: code for code, name in DTYPES.items()}
#: Kinds of header extensions (fixed values).
ECODES = {0: "ignore", 2: "DICOM", 4: "AFNI", 6: "comment", 8: "XCEDE", 10: "JimDimInfo", 12: "WorkflowFwds", 14: "FreeSurfer", 16: "pypickle"}
LABEL_MARK = "volume_labels.v1"


@dataclass
class Header:
    dims: tuple[int, ...]
    pixdim: tuple[float, ...]
    dtype: str = "f4"
    slope: float = 0.0
    inter: float = 0.0
    qform_code: int = 0
    sform_code: int = 0
    quaternion: tuple[float, float, float] = (0.0, 0.0, 0.0)
    qoffset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    srow: np.ndarray = field(default_factory=lambda: np.zeros((3, 4)))
    vox_offset: int = 352
    descrip: str = ""
    magic: str = "n+1"
    endian: str = "<"
    version: int = 1
    extensions: list[tuple[int, bytes]] = field(default_factory=list)

    @property
    def shape(self) -> tuple[int, ...]:
        """Dimensions without trailing ones beyond the third."""
        d = list(self.dims)
        while len(d) > 3 and d[-1] == 1:
            d.pop()
        return tuple(d)

    @property
    def trans(self) -> np.ndarray:
        if self.sform_code > 0 and np.abs(np.linalg.det(self.srow[:, :3])) > 1e-12:
            return np.vstack([self.srow, [0, 0, 0, 1]])
        steps = [abs(p) or 1.0 for p in self.pixdim[1:4]]
        if self.qform_code > 0:
            return affine_of(self.quaternion, self.qoffset, steps, -1.0 if self.pixdim[0] < 0 else 1.0)
        return from_matvec(np.diag(steps))

    @property
    def space(self) -> Space:
        return Space(self.shape if len(self.shape) >= 3 else (*self.shape, 1, 1)[:3], trans=self.trans)

    @property
    def scale(self) -> tuple[float, float]:
        """Slope and intercept; a slope of 0 or one that isn't finite means none."""
        if not math.isfinite(self.slope) or self.slope == 0:
            return 1.0, 0.0
        return self.slope, self.inter if math.isfinite(self.inter) else 0.0

    @property
    def item_size(self) -> int:
        return int(self.dtype[1:])


def parse(data: bytes) -> Header:
    """The header at the beginning of a file; byte order and version are told by its size field."""
    for endian in "<>":
        (size,) = struct.unpack(endian + "i", data[:4])
        if size == 348:
            return _parse1(data, endian)
        if size == 540:
            return _parse2(data, endian)
    raise ValueError("not a NIfTI or ANALYZE header")


def _type(code: int) -> str:
    if code not in DTYPES:
        raise ValueError(f"data type {code} isn't supported")
    return DTYPES[code]


def _parse1(b: bytes, e: str) -> Header:
    u = lambda f, at: struct.unpack_from(e + f, b, at)
    dim = u("8h", 40)
    magic = b[344:348].rstrip(b"\0").decode("ascii", "replace")
    nifti = magic in ("n+1", "ni1")
    h = Header(
        dims=tuple(max(1, d) for d in dim[1 : 1 + max(1, min(7, dim[0]))]), pixdim=u("8f", 76), dtype=_type(u("h", 70)[0]), endian=e, magic=magic,
        vox_offset=int(u("f", 108)[0]), descrip=b[148:228].split(b"\0")[0].decode("latin-1"), version=1 if nifti else 0,
    )
    if nifti:
        h.slope, h.inter = u("2f", 112)
        h.qform_code, h.sform_code = u("2h", 252)
        q = u("6f", 256)
        h.quaternion, h.qoffset, h.srow = q[:3], q[3:], np.array(u("12f", 280)).reshape(3, 4)
        h.extensions = read_extensions(b, 348, h.vox_offset if magic == "n+1" else len(b), e)
    return h


def _parse2(b: bytes, e: str) -> Header:
    u = lambda f, at: struct.unpack_from(e + f, b, at)
    dim = u("8q", 16)
    q = u("6d", 352)
    h = Header(
        dims=tuple(max(1, d) for d in dim[1 : 1 + max(1, min(7, dim[0]))]), pixdim=u("8d", 104), dtype=_type(u("h", 12)[0]), slope=u("d", 176)[0], inter=u("d", 184)[0],
        qform_code=u("i", 344)[0], sform_code=u("i", 348)[0], quaternion=q[:3], qoffset=q[3:], srow=np.array(u("12d", 400)).reshape(3, 4),
        vox_offset=u("q", 168)[0], descrip=b[240:320].split(b"\0")[0].decode("latin-1"), magic=b[4:7].decode("ascii", "replace"), endian=e, version=2,
    )
    h.extensions = read_extensions(b, 540, h.vox_offset, e)
    return h


def read_extensions(data: bytes, at: int, end: int, endian: str) -> list[tuple[int, bytes]]:
    """``(ecode, content)`` of the extensions between the header and the voxels; one of an odd size ends the list."""
    out, end = [], min(end, len(data))
    if at + 4 > end or data[at] == 0:
        return out
    at += 4
    while at + 8 <= end:
        size, code = struct.unpack_from(endian + "2i", data, at)
        if size < 16 or size % 16 or at + size > end:
            break
        out.append((code, data[at + 8 : at + size]))
        at += size
    return out


def header_of(space: Space, dtype: str = "f4", slope: float = 1.0, inter: float = 0.0, tr: float = 1.0, descrip: str = "", extensions=(), version: int | None = None) -> Header:
    """The header of an image on a grid; dimensions beyond 32767 need version 2."""
    version = version or (2 if max(space.dims) > 32767 else 1)
    if version == 1 and max(space.dims) > 32767:
        raise ValueError("NIfTI-1 holds 32767 voxels an axis at most")
    q, sign = quaternion_of(space.trans)
    pixdim = [sign, *voxel_sizes(space.trans), *([tr] if len(space.dims) > 3 else [0.0]), 0.0, 0.0, 0.0]
    base = (352 if version == 1 else 544) + sum(16 * -(-(len(x) + 8) // 16) for _, x in extensions)
    return Header(
        dims=space.dims, pixdim=tuple(pixdim), dtype=dtype, slope=slope, inter=inter, qform_code=1, sform_code=1, quaternion=tuple(q), qoffset=tuple(space.trans[:3, 3]),
        srow=space.trans[:3], vox_offset=base, descrip=descrip, version=version, extensions=list(extensions), magic="n+1" if version == 1 else "n+2",
    )


def pack(h: Header) -> bytes:
    """The bytes before the voxels: header, extensions and padding."""
    e, b = h.endian, bytearray(348 if h.version == 1 else 540)
    dim = [len(h.dims), *h.dims, *[1] * (7 - len(h.dims))]
    put = lambda f, at, *v: struct.pack_into(e + f, b, at, *v)
    if h.version == 1:
        put("i", 0, 348)
        put("8h", 40, *dim)
        put("2h", 70, CODES[h.dtype], 8 * h.item_size)
        put("8f", 76, *h.pixdim)
        put("3f", 108, h.vox_offset, h.slope, h.inter)
        put("B", 123, 10)
        b[148 : 148 + len(h.descrip[:79])] = h.descrip[:79].encode("latin-1", "replace")
        put("2h", 252, h.qform_code, h.sform_code)
        put("18f", 256, *h.quaternion, *h.qoffset, *np.asarray(h.srow).ravel())
        b[344:348] = h.magic.encode() + b"\0"
    else:
        put("i", 0, 540)
        b[4:12] = b"n+2\0\r\n\x1a\n"
        put("2h", 12, CODES[h.dtype], 8 * h.item_size)
        put("8q", 16, *dim)
        put("8d", 104, *h.pixdim)
        put("q2d", 168, h.vox_offset, h.slope, h.inter)
        b[240 : 240 + len(h.descrip[:79])] = h.descrip[:79].encode("latin-1", "replace")
        put("2i", 344, h.qform_code, h.sform_code)
        put("18d", 352, *h.quaternion, *h.qoffset, *np.asarray(h.srow).ravel())
        put("i", 500, 10)
    out = bytes(b) + bytes([1 if h.extensions else 0, 0, 0, 0])
    for code, content in h.extensions:
        size = 16 * -(-(len(content) + 8) // 16)
        out += struct.pack(e + "2i", size, code) + content.ljust(size - 8, b"\0")
    return out.ljust(h.vox_offset, b"\0")


def code_of(kind: int | str) -> int:
    """The code of a kind of extension, given by code or name."""
    if not isinstance(kind, str):
        return int(kind)
    for code, name in ECODES.items():
        if name.lower() == kind.lower():
            return code
    raise ValueError(f"no kind of extension is named {kind}")


def extensions_of(h: Header, kind: int | str | None = None) -> list[bytes]:
    """The contents of a header's extensions, of all or of one kind."""
    return [content for code, content in h.extensions if kind is None or code == code_of(kind)]


def has_extension(h: Header, kind: int | str | None = None) -> bool:
    return bool(extensions_of(h, kind))


def comment(text: str) -> tuple[int, bytes]:
    return 6, text.encode()


def label_extension(labels: list[str]) -> tuple[int, bytes]:
    """Names of volumes as a comment, one to a line, percent-encoded."""
    return comment("\n".join([LABEL_MARK, *(urllib.parse.quote(x) for x in labels)]))


def volume_labels(h: Header, expected: int | None = None) -> tuple[str, ...]:
    """The names in the header's comments; none if their number is wrong."""
    for code, content in h.extensions:
        lines = content.rstrip(b"\0").decode("utf-8", "replace").split("\n")
        if code == 6 and lines[0].endswith(LABEL_MARK):
            names = tuple(urllib.parse.unquote(x) for x in lines[1:])
            return names if expected is None or len(names) == expected else ()
    return ()


def afni_attributes(content: bytes) -> dict[str, list]:
    """Attributes of an AFNI extension (XML), by name, as numbers where they are."""
    root = ElementTree.fromstring(content.rstrip(b"\0").decode("utf-8", "replace"))
    out = {}
    for atr in root.iter("AFNI_atr"):
        text, kind = (atr.text or "").strip(), atr.get("ni_type", "String")
        if kind == "String":
            out[atr.get("atr_name")] = [text.strip('"')]
        else:
            out[atr.get("atr_name")] = [(int if kind == "int" else float)(x) for x in text.split()]
    return out


def parse_afni_head(text: str) -> dict[str, dict]:
    """Attributes of a ``.HEAD`` file: ``{name: {type, count, content}}``."""
    out = {}
    for m in re.finditer(r"type\s*=\s*(\S+)\s*\nname\s*=\s*(\S+)\s*\ncount\s*=\s*(\d+)\s*\n(.*?)(?=\n\s*type\s*=|\Z)", text, re.S):
        kind, name, count, body = m[1], m[2], int(m[3]), m[4].strip("\n ")
        if kind == "string-attribute":
            content = body.lstrip("'")[:count].split("~")[0] if body.endswith("~") else body.lstrip("'")[:count]
        else:
            content = [(int if kind == "integer-attribute" else float)(x) for x in body.split()[:count]]
        out[name] = {"type": kind, "count": count, "content": content}
    return out


def afni_space(attributes: dict[str, dict]) -> Space:
    """The grid of an AFNI dataset, in RAS world coordinates (AFNI's run to left and back)."""
    dims = attributes["DATASET_DIMENSIONS"]["content"][:3]
    times = attributes["DATASET_RANK"]["content"][1]
    orient = attributes["ORIENT_SPECIFIC"]["content"]
    origin, delta = attributes["ORIGIN"]["content"], attributes["DELTA"]["content"]
    # codes 0..5 are R-L, L-R, P-A, A-P, I-S, S-I: pairs along one world axis; AFNI counts x to the left, y to the back
    trans = np.zeros((4, 4))
    trans[3, 3] = 1
    for axis, code in enumerate(orient):
        world = code // 2
        trans[world, axis], trans[world, 3] = delta[axis], origin[axis]
    trans[:2] *= -1
    return Space((*dims, times) if times > 1 else tuple(dims), trans=trans)


def parse_niml(data: bytes, most: int = 10000) -> list[dict]:
    """NIML elements: name, attributes and, for numbers, their table (ASCII or little-endian binary)."""
    out, at = [], 0
    opening = re.compile(rb"<(\w+)((?:\s+[\w.]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))*)\s*(/?)>", re.S)
    while len(out) < most and (m := opening.search(data, at)):
        name = m[1].decode()
        attrs = {k.decode(): v.strip(b"\"'").decode() for k, v in re.findall(rb"([\w.]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", m[2])}
        at, element = m.end(), {"name": name, "attributes": attrs, "data": None}
        out.append(element)
        if m[3] or "ni_type" not in attrs:
            continue
        kinds = [k for part in attrs["ni_type"].split(",") for k in [part.split("*")[-1]] * (int(part.split("*")[0]) if "*" in part else 1)]
        rows = int(attrs.get("ni_dimen", "1"))
        types = {"int": "<i4", "float": "<f4", "double": "<f8", "byte": "u1", "short": "<i2"}
        if attrs.get("ni_form", "").startswith("binary") and all(k in types for k in kinds):
            record = np.dtype([(f"c{n}", types[k]) for n, k in enumerate(kinds)])
            table = np.frombuffer(data, record, rows, at)
            element["data"], at = np.stack([table[f].astype(float) for f in record.names], axis=1), at + rows * record.itemsize
        else:
            end = data.find(b"</" + m[1], at)
            text = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace")
            element["data"] = [text.strip().strip('"')] if "String" in kinds else np.array(text.split(), float).reshape(rows, -1)
            at = end if end >= 0 else len(data)
    return out
