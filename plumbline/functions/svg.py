"""Drawings in SVG: elements with path data, and the exact bounding box of a path."""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.pathboxes import path_boxes

TOKEN = re.compile(r"([MmLlHhVvCcSsQqTtAaZz])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([\s,]+)|(.)")
ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}

#: Bytes of a drawing, or of path data, that are looked at together.
PART_BYTES = 1 << 20
BOX = "x0 double, y0 double, x1 double, y1 double"


def events(svg: bytes | memoryview) -> Iterator[list[tuple]]:
    """(ord, d, semantic_id, instance_id, the root's viewBox) of every element with path data and a semantic id, in document order.

    Elements are told as they are read, a part of the text at a time; no tree
    is made. Raises ExpatError where the text is no XML.
    """
    found: list[tuple] = []
    seen, view = 0, None

    def element(_, attributes: dict[str, str]) -> None:
        nonlocal seen, view
        if not seen:
            view = attributes.get("viewBox")
        if "d" in attributes and "semantic-id" in attributes:
            found.append((seen, attributes["d"], attributes["semantic-id"], attributes.get("instance-id"), view))
        seen += 1

    def unknown(*_) -> None:
        raise expat.ExpatError("undefined entity")

    parser = expat.ParserCreate("utf-8", "}")
    parser.StartElementHandler, parser.SkippedEntityHandler = element, unknown
    for at in range(0, len(svg), PART_BYTES):
        parser.Parse(bytes(svg[at : at + PART_BYTES]), False)
        if found:
            yield found
            found = []
    parser.Parse(b"", True)
    if found:
        yield found


def elements_of(svg: bytes | memoryview) -> Iterator[list[tuple]]:
    """``events`` of a text that is XML to its end; none of another. A text of one part is read once, a longer one is checked first."""
    try:
        if len(svg) <= PART_BYTES:
            whole: Iterable[list[tuple]] = list(events(svg))
        else:
            for _ in events(svg):
                pass
            whole = events(svg)
    except expat.ExpatError:
        return
    yield from whole


def view_box(svg: str | None) -> str | None:
    try:
        return ElementTree.fromstring(svg or "").get("viewBox")
    except ElementTree.ParseError:
        return None


def elements(docs: DataFrame, id_col: str = "scene_id", svg_col: str = "svg", view: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each usable element; ids parsed, a missing or empty instance id is -1, a semantic id that is no number drops the row.

    ``view``: with the size of the drawing's own viewBox, ``view_w`` and ``view_h``. ``keep``: further columns of ``docs``.
    """

    kept = [id_col, *keep]
    made = pa.schema([("ord", pa.int32()), *((c, pa.string()) for c in ("d", "semantic_id", "instance_id", "view_box"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(svg_col)
            for i in range(batch.num_rows):
                for part in elements_of(memoryview(texts[i].as_buffer())) if texts[i].is_valid else ():
                    columns = [pa.array(values, kind) for values, kind in zip(zip(*part), made.types)]
                    same = [batch.column(c).take(pa.array(np.full(len(part), i))) for c in kept]
                    yield pa.RecordBatch.from_arrays(same + columns, kept + made.names)

    schema = StructType([*(docs.schema[c] for c in kept), *StructType.fromDDL("ord int, d string, semantic_id string, instance_id string, view_box string")])
    rows = docs.select(*kept, svg_col).mapInArrow(read, schema)
    sizes = [size.alias(name) for size, name in zip(view_size(F.col("view_box")), ("view_w", "view_h"))] if view else []
    return rows.select(
        id_col,
        *keep,
        "ord",
        "d",
        *ids_of(),
        *sizes,
    ).where("sid is not null")


def boxed(docs: DataFrame, svg_col: str = "svg", keep: tuple[str, ...] = (), opened: Callable[[pa.RecordBatch, int], tuple[bytes | memoryview | None, bytes | None]] | None = None) -> DataFrame:
    """``elements`` and ``with_boxes`` in one pass, so that path data never leaves it: a row for each part of a drawing, with ``keep``, ``view_box`` and ``paths``.

    ``opened`` gives the text of a row of a batch, and bytes that come with it
    as column ``header``; without it the text is ``svg_col``'s. Drawings leave
    together up to ``PART_BYTES`` of their text.
    """
    made = pa.schema([("ord", pa.int32()), ("semantic_id", pa.string()), ("instance_id", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))])
    columns = (*keep, *(("header",) if opened else ()), "view_box", "paths")

    def text_of(batch: pa.RecordBatch, i: int) -> tuple[memoryview | None, None]:
        value = batch.column(svg_col)[i]
        return (memoryview(value.as_buffer()) if value.is_valid else None), None

    def built(batch: pa.RecordBatch, held: list[tuple[int, bytes | None, list[tuple]]]) -> pa.RecordBatch:
        orders, data, *ids, views = zip(*(path for _, _, part in held for path in part))
        boxes = path_boxes(data)
        has = np.isfinite(boxes[:, 0])
        ends = np.cumsum([0, *(len(part) for *_, part in held)])
        fields = [pa.array(values, kind) for values, kind in zip((orders, *ids), made.types)] + [pa.array(boxes[:, i]) for i in range(4)]
        paths = pa.ListArray.from_arrays(np.append(0, np.cumsum(has))[ends].astype(np.int32), pa.StructArray.from_arrays(fields, made.names).filter(pa.array(has)))
        rows = pa.array([i for i, *_ in held])
        headers = [pa.array([header for _, header, _ in held], pa.binary())] if opened else []
        views = pa.array([views[at] for at in ends[:-1]], pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), *headers, views, paths], list(columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                text, header = (opened or text_of)(batch, i)
                for part in elements_of(text) if text is not None else ():
                    held.append((i, header, part))
                    size += sum(len(path[1]) for path in part)
                    if size >= PART_BYTES:
                        yield built(batch, held)
                        held, size = [], 0
            if held:
                yield built(batch, held)

    paths = "paths array<struct<ord: int, semantic_id: string, instance_id: string, x0: double, y0: double, x1: double, y1: double>>"
    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(f"{'header binary, ' if opened else ''}view_box string, {paths}")])
    return docs.mapInArrow(read, schema) if opened else docs.select(*{*keep, svg_col}).mapInArrow(read, schema)


def boxed_paths(drawings: DataFrame, *keep: str) -> DataFrame:
    """One row for each path of ``boxed`` that has a semantic id, with ``keep``, the ids and box as of ``with_boxes`` and the size of the drawing's viewBox."""
    sizes = [size.alias(name) for size, name in zip(view_size(F.col("view_box")), ("view_w", "view_h"))]
    # Sizes are told once a drawing, not once a path.
    return drawings.select(*keep, *sizes, F.inline("paths")).select(*keep, "ord", *ids_of(), "view_w", "view_h", "x0", "y0", "x1", "y1").where("sid is not null")


def ids_of() -> tuple[Column, Column]:
    """Semantic and instance id of their texts; a missing or empty instance id is -1."""
    iid = F.coalesce(F.nullif(F.col("instance_id"), F.lit("")).try_cast("int"), F.lit(-1))
    return F.col("semantic_id").try_cast("int").alias("sid"), iid.alias("iid")


def view_size(box: Column) -> tuple[Column, Column]:
    """Width and height of a viewBox; its origin is not used. Fewer than four numbers, or none: 100."""
    parts = F.split(F.trim(F.coalesce(box, F.lit("0 0 100 100"))), r"\s+")
    enough = F.size(parts) >= 4
    return tuple(F.when(enough, F.get(parts, F.lit(i)).try_cast("double")).otherwise(F.lit(100.0)) for i in (2, 3))


def _arguments(d: str) -> list[tuple[str, list[float]]]:
    """Commands with their numbers. Raises ValueError on anything else."""
    out: list[tuple[str, list[float]]] = []
    for command, number, _, other in TOKEN.findall(d):
        if other:
            raise ValueError(f"unexpected {other!r}")
        if command:
            out.append((command, []))
        elif number:
            if not out:
                raise ValueError("numbers before a command")
            out[-1][1].append(float(number))
    return out


def _bezier_turns(p: list[float]) -> list[float]:
    """Parameters inside (0, 1) where one coordinate of a quadratic or cubic turns."""
    if len(p) == 3:
        bend = p[0] - 2 * p[1] + p[2]
        roots = [(p[0] - p[1]) / bend] if bend else []
    else:
        a = -p[0] + 3 * p[1] - 3 * p[2] + p[3]
        b = 2 * (p[0] - 2 * p[1] + p[2])
        c = p[1] - p[0]
        if abs(a) < 1e-12:
            roots = [-c / b] if b else []
        else:
            under = b * b / 4 - a * c
            roots = [] if under < 0 else [(-b / 2 + s * math.sqrt(under)) / a for s in (1, -1)]
    return [t for t in roots if 0 < t < 1]


def _bezier(p: list[float], t: float) -> float:
    while len(p) > 1:
        p = [u + (v - u) * t for u, v in zip(p, p[1:])]
    return p[0]


def _curve_points(points: list[complex]) -> list[complex]:
    """End points and turning points of a Bezier curve."""
    turns = {t for axis in ("real", "imag") for t in _bezier_turns([getattr(p, axis) for p in points])}
    return [points[0], points[-1], *(complex(_bezier([p.real for p in points], t), _bezier([p.imag for p in points], t)) for t in turns)]


def _arc_points(start: complex, rx: float, ry: float, turn: float, large: bool, sweep: bool, end: complex) -> list[complex]:
    """End points and extremes of an elliptical arc given by its end points."""
    rx, ry = abs(rx), abs(ry)
    if start == end:
        return [start]
    if not rx or not ry:
        return [start, end]
    axis = cmath.exp(1j * math.radians(turn))
    half = (start - end) / 2 / axis
    u = complex(half.real / rx, half.imag / ry)
    if abs(u) > 1:
        rx, ry, u = rx * abs(u), ry * abs(u), u / abs(u)
    side = math.sqrt(max(0.0, 1 / abs(u) ** 2 - 1)) * (1 if large != sweep else -1)
    middle = complex(u.imag, -u.real) * side
    first, last = cmath.phase(u - middle), cmath.phase(-u - middle)
    span = (last - first) % (2 * math.pi) if sweep else -((first - last) % (2 * math.pi))
    centre = complex(middle.real * rx, middle.imag * ry) * axis + (start + end) / 2

    def at(angle):
        return centre + complex(rx * math.cos(angle), ry * math.sin(angle)) * axis

    cos, sin = axis.real, axis.imag
    candidates = [math.atan2(-ry * sin, rx * cos), math.atan2(ry * cos, rx * sin)]
    points = [start, end]
    for angle in candidates:
        for extra in (0, math.pi):
            gone = (angle + extra - first) % (2 * math.pi) if span >= 0 else -((first - angle - extra) % (2 * math.pi))
            if abs(gone) <= abs(span):
                points.append(at(angle + extra))
    return points


def path_box(d: str | None) -> tuple[float, float, float, float] | None:
    """Exact bounding box of path data; None if it is empty, draws nothing or cannot be parsed."""
    try:
        commands = _arguments(d or "")
    except ValueError:
        return None
    here = begun = control = 0j
    last, points = "", []
    for command, numbers in commands:
        kind, size = command.upper(), ARGUMENTS[command.upper()]
        if len(numbers) % size if size else numbers:
            return None
        if size and not numbers or not last and kind != "M":
            return None
        groups = [numbers[i : i + size] for i in range(0, len(numbers), size)] if size else [[]]
        for i, n in enumerate(groups):
            base = here if command.islower() else 0j
            start = here
            if kind == "Z":
                if here != begun:
                    points += [here, begun]
                here = begun
            elif kind == "M" and i == 0:
                here = begun = base + complex(*n)
            elif kind in "ML":
                here = base + complex(*n)
                points += [start, here]
            elif kind == "H":
                here = complex(base.real + n[0], here.imag)
                points += [start, here]
            elif kind == "V":
                here = complex(here.real, base.imag + n[0])
                points += [start, here]
            elif kind in "CS":
                first = base + complex(*n[:2]) if kind == "C" else 2 * here - control if last in "CS" else here
                control, here = base + complex(*n[-4:-2]), base + complex(*n[-2:])
                points += _curve_points([start, first, control, here])
            elif kind in "QT":
                control = base + complex(*n[:2]) if kind == "Q" else 2 * here - control if last in "QT" else here
                here = base + complex(*n[-2:])
                points += _curve_points([start, control, here])
            else:
                here = base + complex(*n[5:])
                points += _arc_points(start, *n[:3], bool(n[3]), bool(n[4]), here)
            last = kind
    if not points:
        return None
    xs, ys = [p.real for p in points], [p.imag for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def with_boxes(paths: DataFrame, d_col: str = "d") -> DataFrame:
    """``paths`` with x0, y0, x1, y1; paths without a box are dropped."""

    def boxes(column: pd.Series) -> pd.DataFrame:
        found, start, size = [], 0, 0
        for i, d in enumerate(column):
            size += len(d or "")
            if size > PART_BYTES or i + 1 == len(column):
                found.append(path_boxes(column.iloc[start : i + 1].tolist()))
                start, size = i + 1, 0
        whole = np.concatenate(found) if found else np.zeros((0, 4))
        return pd.DataFrame(whole, columns=["x0", "y0", "x1", "y1"])

    box = F.pandas_udf(boxes, BOX)
    return paths.withColumn("box", box(F.col(d_col))).where("box.x0 is not null").select(*paths.columns, "box.*")
