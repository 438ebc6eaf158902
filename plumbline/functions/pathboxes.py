"""Exact bounding boxes of many paths at once: flat arrays of all their tokens, segments and curves.

Gives what ``svg.path_box`` gives path by path. Numbers of all paths are found
by what each byte may follow and parsed together; current points run through
the segments of all paths in step, in the order in which one path would add
them up; turning points of all curves of a kind are solved together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of segment by upper-case command, and how many numbers each takes.
KINDS = "MLHVCSQTAZ"
ARGUMENTS = np.array([2, 2, 1, 1, 6, 4, 4, 2, 7, 0])
M, L, H, V, C, S, Q, T, A, Z = range(10)
#: Paths that have this many segments left go on one by one.
FEW = 12

SPACE, DIGIT, DOT, SIGN, E, COMMAND, OTHER = range(7)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    kind, command = np.full(256, OTHER, np.uint8), np.full(256, -1, np.int8)
    for chars, k in ((" \t\n\r\x0b\x0c,\x1c\x1d\x1e\x1f", SPACE), ("0123456789", DIGIT), (".", DOT), ("+-", SIGN), ("eE", E)):
        for c in chars:
            kind[ord(c)] = k
    for i, c in enumerate(KINDS):
        for x in (c, c.lower()):
            kind[ord(x)], command[ord(x)] = COMMAND, i
    return kind, command


BYTES, COMMANDS = _byte_classes()
NUMERIC = np.isin(np.arange(7), (DIGIT, DOT, SIGN, E))


class Tokens:
    """Commands and numbers of all paths in one row of bytes, and which paths cannot be read."""

    def __init__(self, paths: list[bytes]) -> None:
        flat = np.frombuffer(b" ".join([b"", *paths, b" "]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths)) + 1)
        kind = BYTES[flat]
        numeric = NUMERIC[kind]
        # A number starts behind what is no part of one, and at a sign that is no exponent's.
        first = numeric[1:] & (~numeric[:-1] | (kind[1:] == SIGN) & (kind[:-1] != E))
        starts = np.flatnonzero(first) + 1
        dots, es, signs = (np.flatnonzero(kind == k) for k in (DOT, E, SIGN))
        # A second dot, or one behind an exponent, starts another number.
        dot_run, e_run = (np.searchsorted(starts, at, side="right") for at in (dots, es))
        again = np.append(False, dot_run[1:] == dot_run[:-1]) if len(dots) else np.zeros(0, bool)
        if len(es):
            before = np.searchsorted(es, dots)
            again |= (before > 0) & (e_run[np.maximum(before - 1, 0)] == dot_run)
        if again.any():
            starts = np.union1d(starts, dots[again])
            e_run = np.searchsorted(starts, es, side="right")
        wrong = [np.flatnonzero(kind == OTHER)]
        if len(dots):  # a digit beside it, of the same number
            behind = (kind[dots - 1] == DIGIT) & ~again
            wrong.append(dots[~behind & (kind[dots + 1] != DIGIT)])
        if len(es):  # a number before, one behind, and no other exponent in the number
            twice = np.append(False, e_run[1:] == e_run[:-1])
            power = (kind[es + 1] == DIGIT) | (kind[es + 1] == SIGN) & (kind[es + 2] == DIGIT)
            wrong.append(es[twice | ~power | (kind[es - 1] != DIGIT) & (kind[es - 1] != DOT)])
        if len(signs):
            number = (kind[signs + 1] == DIGIT) | (kind[signs + 1] == DOT) & (kind[np.minimum(signs + 2, len(kind) - 1)] == DIGIT)
            wrong.append(signs[(kind[signs - 1] != E) & ~number])
        self.bad = np.zeros(len(paths), bool)
        self.bad[np.searchsorted(ends, np.concatenate(wrong))] = True
        commands = np.flatnonzero(kind == COMMAND)
        self.command_path, self.number_path = np.searchsorted(ends, commands), np.searchsorted(ends, starts)
        if self.bad.any():
            for i in np.flatnonzero(self.bad):
                numeric[ends[i] - len(paths[i]) : ends[i] + 1] = False
            commands, starts = commands[~self.bad[self.command_path]], starts[~self.bad[self.number_path]]
            self.command_path, self.number_path = np.searchsorted(ends, commands), np.searchsorted(ends, starts)
        # The numbers' bytes alone, one number behind the other; the parser takes no plus before a number.
        numeric[starts[flat[starts] == ord("+")]] = False
        offsets = np.append(np.cumsum(numeric)[starts] - numeric[starts], numeric.sum())
        text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat[numeric].tobytes()))
        self.numbers = pc.cast(text, pa.float64()).to_numpy(zero_copy_only=False)
        self.number_at, self.command_at = starts, commands
        self.command, self.relative = COMMANDS[flat[commands]], flat[commands] >= 97


class Segments:
    """One entry for each command and repetition: kind, if relative, path, and where its numbers start."""

    def __init__(self, tokens: Tokens) -> None:
        bad, size = tokens.bad, len(tokens.command_at)
        owner = np.searchsorted(tokens.command_at, tokens.number_at) - 1
        lost = (owner < 0) | (np.append(tokens.command_path, -1)[owner] != tokens.number_path)
        bad[tokens.number_path[lost]] = True
        counts = np.bincount(owner[~lost], minlength=size)
        first_number = np.searchsorted(tokens.number_at, tokens.command_at)
        sizes = ARGUMENTS[tokens.command]
        wrong = np.where(sizes > 0, (counts == 0) | (counts % np.maximum(sizes, 1) > 0), counts > 0)
        wrong |= (np.diff(tokens.command_path, prepend=-1) != 0) & (tokens.command != M)
        bad[tokens.command_path[wrong]] = True
        kept = np.flatnonzero(~bad[tokens.command_path])
        times = np.where(sizes[kept] > 0, counts[kept] // np.maximum(sizes[kept], 1), 1)
        of = np.repeat(kept, times)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        self.kind = np.where((tokens.command[of] == M) & (turn > 0), L, tokens.command[of])
        self.relative, self.path = tokens.relative[of], tokens.command_path[of]
        self.number = first_number[of] + turn * sizes[of]
        self.numbers = np.append(tokens.numbers, np.zeros(8))

    def arg(self, i: int) -> np.ndarray:
        return self.numbers[self.number + i]


def _walk(s: Segments) -> tuple[np.ndarray, ...]:
    """Start, end and last control point of every segment, as columns x and y."""
    total = len(s.kind)
    start, end, control = np.zeros((total, 2)), np.zeros((total, 2)), np.zeros((total, 2))
    if not total:
        return start, end, control
    last = s.number + ARGUMENTS[s.kind]
    to = np.stack([s.numbers[np.maximum(last - 2, s.number)], s.numbers[np.maximum(last - 1, s.number)]], 1)
    # Of V the only number is the second one as well; the other coordinate stays.
    inner = np.zeros((total, 2))
    for kind, at in ((C, 2), (S, 0), (Q, 0)):
        these = s.number[s.kind == kind] + at
        inner[s.kind == kind] = np.stack([s.numbers[these], s.numbers[these + 1]], 1)
    lead = np.flatnonzero(np.append(True, s.path[1:] != s.path[:-1]))
    sizes = np.diff(np.append(lead, total))
    order = np.argsort(-sizes, kind="stable")
    lead, sizes = lead[order], sizes[order]
    here, begun, hold = np.zeros((len(lead), 2)), np.zeros((len(lead), 2)), np.zeros((len(lead), 2))
    before = np.full(len(lead), -1)
    step, n = 0, len(lead)
    while n > FEW:
        at = lead[:n] + step
        kind, base = s.kind[at], np.where(s.relative[at][:, None], here[:n], 0.0)
        start[at] = here[:n]
        target = base + to[at]
        target[kind == H, 1], target[kind == V, 0] = here[:n][kind == H, 1], here[:n][kind == V, 0]
        target[kind == Z] = begun[:n][kind == Z]
        smooth = kind == T
        held = np.where(((before[:n] == Q) | (before[:n] == T))[:, None], 2 * here[:n] - hold[:n], here[:n])
        fresh = np.where(smooth[:, None], held, base + inner[at])
        # What a later S or T reflects; the first control of an S comes from the one before it.
        control[at] = np.where((kind == S)[:, None], np.where(((before[:n] == C) | (before[:n] == S))[:, None], 2 * here[:n] - hold[:n], here[:n]), fresh)
        hold[:n] = fresh
        moved = kind == M
        begun[:n][moved] = target[moved]
        here[:n], before[:n] = target, kind
        end[at] = target
        step += 1
        n = int(np.searchsorted(-sizes, -step, side="left"))
    for i in range(n):
        x, y = here[i].tolist()
        bx, by = begun[i].tolist()
        hx, hy = hold[i].tolist()
        prior = int(before[i])
        span = slice(lead[i] + step, lead[i] + sizes[i])
        rows_in = zip(s.kind[span].tolist(), s.relative[span].tolist(), to[span].tolist(), inner[span].tolist())
        made = []
        for kind, relative, (tx, ty), (ix, iy) in rows_in:
            ox, oy = (x, y) if relative else (0.0, 0.0)
            ex, ey = (bx, by) if kind == Z else (x if kind == V else ox + tx, y if kind == H else oy + ty)
            fx, fy = ((2 * x - hx, 2 * y - hy) if prior in (Q, T) else (x, y)) if kind == T else (ox + ix, oy + iy)
            cx, cy = ((2 * x - hx, 2 * y - hy) if prior in (C, S) else (x, y)) if kind == S else (fx, fy)
            made.append((x, y, ex, ey, cx, cy))
            if kind == M:
                bx, by = ex, ey
            hx, hy, x, y, prior = fx, fy, ex, ey, kind
        if made:
            made = np.array(made)
            start[span], end[span], control[span] = made[:, :2], made[:, 2:4], made[:, 4:]
    return start, end, control


def _bezier_reach(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values of curves, a coordinate at a time: ends and turning points inside."""
    p = points
    low, high = np.minimum(p[0], p[-1]), np.maximum(p[0], p[-1])
    if len(p) == 3:
        bend = p[0] - 2 * p[1] + p[2]
        roots = [np.where(bend != 0, (p[0] - p[1]) / bend, np.nan)]
    else:
        a, b, c = -p[0] + 3 * p[1] - 3 * p[2] + p[3], 2 * (p[0] - 2 * p[1] + p[2]), p[1] - p[0]
        flat, under = abs(a) < 1e-12, b * b / 4 - a * c
        one = np.where(b != 0, -c / b, np.nan)
        root = np.sqrt(under)
        roots = [np.where(flat, one, (-b / 2 + root) / a), np.where(flat, np.nan, (-b / 2 - root) / a)]
    for t in roots:
        inside = (t > 0) & (t < 1)
        q = p
        while len(q) > 1:
            q = [u + (v - u) * t for u, v in zip(q, q[1:])]
        low, high = np.where(inside, np.minimum(low, q[0]), low), np.where(inside, np.maximum(high, q[0]), high)
    return low, high


def _arc_reach(start: np.ndarray, end: np.ndarray, rx, ry, turn, large, sweep) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x and y of elliptical arcs: ends, and those of the ellipse's extremes that the arc passes."""
    low, high = np.minimum(start, end), np.maximum(start, end)
    z0, z1 = start[:, 0] + 1j * start[:, 1], end[:, 0] + 1j * end[:, 1]
    rx, ry = abs(rx), abs(ry)
    round_ = (z0 != z1) & (rx > 0) & (ry > 0)
    axis = np.exp(1j * np.radians(turn))
    half = (z0 - z1) / 2 / axis
    u = half.real / rx + 1j * (half.imag / ry)
    far = np.maximum(abs(u), 1.0)
    rx, ry, u = rx * far, ry * far, np.where(far > 1, u / abs(u), u)
    # Radii that do not reach are stretched until the centre lies between the ends.
    side = np.where(far > 1, 0.0, np.sqrt(np.maximum(0.0, 1 / abs(u) ** 2 - 1))) * np.where(large != sweep, 1, -1)
    middle = (u.imag - 1j * u.real) * side
    first, last = np.angle(u - middle), np.angle(-u - middle)
    span = np.where(sweep, (last - first) % (2 * np.pi), -((first - last) % (2 * np.pi)))
    centre = (middle.real * rx + 1j * (middle.imag * ry)) * axis + (z0 + z1) / 2
    for angle in (np.arctan2(-ry * axis.imag, rx * axis.real), np.arctan2(ry * axis.real, rx * axis.imag)):
        for extra in (0, np.pi):
            gone = np.where(span >= 0, (angle + extra - first) % (2 * np.pi), -((first - angle - extra) % (2 * np.pi)))
            on = round_ & (abs(gone) <= abs(span))
            at = centre + (rx * np.cos(angle + extra) + 1j * (ry * np.sin(angle + extra))) * axis
            at = np.stack([at.real, at.imag], 1)
            low, high = np.where(on[:, None], np.minimum(low, at), low), np.where(on[:, None], np.maximum(high, at), high)
    return low, high


def path_boxes(paths: list[str | None]) -> np.ndarray:
    """x0, y0, x1, y1 of each path; not a number where it is empty, draws nothing or cannot be parsed."""
    out = np.full((len(paths), 4), np.nan)
    if not paths:
        return out
    # A character that is no ASCII becomes one byte that no path may have.
    with np.errstate(all="ignore"):
        s = Segments(Tokens([(d or "").encode("ascii", "replace") for d in paths]))
        start, end, control = _walk(s)
        low, high = np.minimum(start, end), np.maximum(start, end)
        for kinds, count in (((C, S), 3), ((Q, T), 2)):
            at = np.flatnonzero(np.isin(s.kind, kinds))
            if len(at):
                points = [start[at], control[at], end[at]]
                if count == 3:
                    base = np.where(s.relative[at][:, None], start[at], 0.0)
                    second = np.where(s.kind[at] == C, 2, 0)
                    numbers = np.stack([s.numbers[s.number[at] + second], s.numbers[s.number[at] + second + 1]], 1)
                    first = np.where((s.kind[at] == C)[:, None], base + np.stack([s.numbers[s.number[at]], s.numbers[s.number[at] + 1]], 1), control[at])
                    points = [start[at], first, base + numbers, end[at]]
                low[at], high[at] = _bezier_reach(points)
        at = np.flatnonzero(s.kind == A)
        if len(at):
            rx, ry, turn, large, sweep = (s.arg(i)[at] for i in range(5))
            low[at], high[at] = _arc_reach(start[at], end[at], rx, ry, turn, large != 0, sweep != 0)
        drawn = (s.kind != M) & ~((s.kind == Z) & (start == end).all(1))
        path = s.path[drawn]
        if len(path):
            lead = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            out[path[lead], :2] = np.minimum.reduceat(low[drawn], lead)
            out[path[lead], 2:] = np.maximum.reduceat(high[drawn], lead)
    return out
