"""Algebra of affine matrices and anatomical orientations."""

from __future__ import annotations

import itertools

import numpy as np

from ..space import Space

#: Letters of the negative and positive end of each world axis (fixed values).
LABELS = (("L", "R"), ("P", "A"), ("I", "S"))


def apply_affine(affine, points) -> np.ndarray:
    a, p = np.asarray(affine, float), np.asarray(points, float)
    return p @ a[:-1, :-1].T + a[:-1, -1]


def to_matvec(affine) -> tuple[np.ndarray, np.ndarray]:
    a = np.asarray(affine, float)
    return a[:-1, :-1], a[:-1, -1]


def from_matvec(matrix, vector=None) -> np.ndarray:
    m = np.asarray(matrix, float)
    out = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
    out[:-1, :-1], out[-1, -1] = m, 1
    if vector is not None:
        out[:-1, -1] = vector
    return out


def append_diag(affine, steps, starts=()) -> np.ndarray:
    """The affine with more axes of their own steps and starts."""
    a, steps = np.asarray(affine, float), np.atleast_1d(np.asarray(steps, float))
    starts = np.asarray(starts, float) if len(starts) else np.zeros(len(steps))
    if len(starts) != len(steps):
        raise ValueError("steps and starts differ in number")
    m, v = to_matvec(a)
    whole = np.zeros((m.shape[0] + len(steps), m.shape[1] + len(steps)))
    whole[: m.shape[0], : m.shape[1]] = m
    whole[m.shape[0] :, m.shape[1] :] = np.diag(steps)
    return from_matvec(whole, np.concatenate([v, starts]))


def dot_reduce(*matrices) -> np.ndarray:
    return np.linalg.multi_dot(matrices) if len(matrices) > 2 else matrices[0] @ matrices[1] if len(matrices) == 2 else matrices[0]


def voxel_sizes(affine) -> np.ndarray:
    m, _ = to_matvec(affine)
    return np.sqrt((m * m).sum(axis=0))


def obliquity(affine) -> np.ndarray:
    """The angle of each axis to the nearest world axis, in radians."""
    m, _ = to_matvec(affine)
    return np.arccos(np.clip(np.abs(m / voxel_sizes(affine)).max(axis=1), -1, 1))


def rescale_affine(affine, shape, zooms, new_shape=None) -> np.ndarray:
    """New voxel sizes with the world position of the middle voxel kept."""
    m, _ = to_matvec(affine)
    shape = np.asarray(shape)
    new_shape = shape if new_shape is None else np.asarray(new_shape)
    scaled = m @ np.diag(np.asarray(zooms, float) / voxel_sizes(affine))
    middle = apply_affine(affine, (shape - 1) // 2)
    return from_matvec(scaled, middle - scaled @ ((new_shape - 1) // 2))


def affine_to_orientation(affine) -> np.ndarray:
    """For each voxel axis the world axis (from 0) it runs along and the direction; NaN for an axis of no length."""
    m, _ = to_matvec(affine)
    size = voxel_sizes(affine)
    u, s, vt = np.linalg.svd(m / np.where(size == 0, 1, size), full_matrices=False)
    keep = s > s.max() * max(m.shape) * np.finfo(float).eps
    rotation = u[:, keep] @ vt[keep]
    out = np.full((m.shape[1], 2), np.nan)
    open_ = np.ones(m.shape[0], bool)
    for axis in np.argsort(-(rotation**2).max(axis=0), kind="stable"):
        column = np.where(open_, rotation[:, axis], 0)
        if not np.allclose(column, 0):
            world = int(np.argmax(np.abs(column)))
            out[axis] = world, -1 if column[world] < 0 else 1
            open_[world] = False
    return out


def orientation_to_axcodes(orientation, labels=LABELS) -> tuple[str | None, ...]:
    return tuple(None if np.isnan(w) else labels[int(w)][int(d > 0)] for w, d in orientation)


def axcodes_to_orientation(codes, labels=LABELS) -> np.ndarray:
    out = np.full((len(codes), 2), np.nan)
    for n, code in enumerate(codes):
        for world, ends in enumerate(labels):
            if code in ends:
                out[n] = world, 1 if ends[1] == code else -1
    return out


def affine_to_axcodes(affine, labels=LABELS):
    return orientation_to_axcodes(affine_to_orientation(affine), labels)


def orientation_transform(start, end) -> np.ndarray:
    """What takes an image of one orientation to another: for each axis its new place and whether it is turned."""
    start, end = np.asarray(start), np.asarray(end)
    out = np.empty_like(start)
    for new, (world, direction) in enumerate(end):
        old = int(np.flatnonzero(start[:, 0] == world)[0])
        out[old] = new, 1 if start[old, 1] == direction else -1
    return out


def inverse_orientation_affine(transform, shape) -> np.ndarray:
    """Voxels of the reoriented grid to voxels of the old one, from 0."""
    n = len(transform)
    out = np.zeros((n + 1, n + 1))
    out[n, n] = 1
    for old, (new, direction) in enumerate(np.asarray(transform)):
        out[old, int(new)] = direction
        if direction < 0:
            out[old, n] = shape[old] - 1
    return out


def anatomy_catalogue() -> list[tuple[str, str, str]]:
    """All 48 orientations of three axes, by rule: each order of the world axes, each choice of ends."""
    return [tuple(LABELS[w][e] for w, e in zip(order, ends)) for order in itertools.permutations(range(3)) for ends in itertools.product((0, 1), repeat=3)]


def plane_catalogue() -> list[tuple[str, str]]:
    """The 24 orientations of slices."""
    return [(LABELS[a][x], LABELS[b][y]) for a, b in itertools.permutations(range(3), 2) for x, y in itertools.product((0, 1), repeat=2)]


def output_aligned_space(space: Space, sizes=None) -> Space:
    """The smallest grid along the world axes that holds a space."""
    sizes = np.full(3, min(space.spacing)) if sizes is None else np.broadcast_to(np.asarray(sizes, float), 3)
    corners = apply_affine(space.trans, list(itertools.product(*[(0, d - 1) for d in space.space_dims])))
    low, high = corners.min(axis=0), corners.max(axis=0)
    shape = np.ceil(np.round((high - low) / sizes, 6)).astype(int) + 1
    return Space(tuple(shape), trans=from_matvec(np.diag(sizes), low))


def slice_to_volume_affine(index: int, axis: int) -> np.ndarray:
    """The affine from voxels of a slice (4 x 3) to those of its volume; axis and index from 0."""
    out = np.zeros((4, 3))
    for column, row in enumerate([a for a in range(3) if a != axis]):
        out[row, column] = 1
    out[axis, 2], out[3, 2] = index, 1
    return out


def quaternion_of(matrix) -> tuple[np.ndarray, float]:
    """``(b, c, d)`` and the sign of the third axis of a NIfTI quaternion."""
    m = np.array(matrix, float)[:3, :3]
    m = m / np.sqrt((m * m).sum(axis=0))
    u, _, vt = np.linalg.svd(m)
    r = u @ vt
    sign = 1.0
    if np.linalg.det(r) < 0:
        r[:, 2], sign = -r[:, 2], -1.0
    # the largest eigenvector of this symmetric matrix is the quaternion
    xx, xy, xz, yx, yy, yz, zx, zy, zz = r.ravel()
    k = np.array([[xx - yy - zz, 0, 0, 0], [yx + xy, yy - xx - zz, 0, 0], [zx + xz, zy + yz, zz - xx - yy, 0], [zy - yz, xz - zx, yx - xy, xx + yy + zz]]) / 3
    values, vectors = np.linalg.eigh(k)
    q = vectors[[3, 0, 1, 2], np.argmax(values)]
    return (-q if q[0] < 0 else q)[1:], sign


def affine_of(quaternion, origin, steps, sign: float = 1.0) -> np.ndarray:
    b, c, d = quaternion
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    return from_matvec(r * (np.asarray(steps, float) * [1, 1, sign or 1.0]), origin)
