"""Texts that describe plans: shading scripts, colour scales, projections. Errors tell the column they are found at."""

from __future__ import annotations

import math
import re
from typing import Any

from ..functions import color, projections
from .shading import Composite, Leaf


class ScriptError(ValueError):
    def __init__(self, message: str, column: int):
        super().__init__(f"{message} (column {column})")
        self.column = column


_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_VALUE = re.compile(r"'([^']*)'|([^\s,()'|]+)")


def parse_steps(text: str) -> list[tuple[str, dict[str, str]]]:
    """step[(name=value, ...)] |+ step ...: names and raw parameters; spaces are free, values may stand in quotes."""
    at, steps = 0, []

    def skip() -> None:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def take(token: str) -> bool:
        nonlocal at
        skip()
        if text.startswith(token, at):
            at += len(token)
            return True
        return False

    def match(pattern: re.Pattern, what: str) -> re.Match:
        nonlocal at
        skip()
        m = pattern.match(text, at)
        if not m:
            raise ScriptError(f"Expected {what}", at)
        at = m.end()
        return m

    if not text.strip():
        raise ScriptError("The script is empty", 0)
    while True:
        name, parameters = match(_NAME, "a step name")[0], {}
        if take("("):
            while not take(")"):
                if parameters and not take(","):
                    raise ScriptError("Expected ',' or ')'", at)
                key = match(_NAME, "a parameter name")[0]
                if not take("="):
                    raise ScriptError("Expected '='", at)
                m = match(_VALUE, "a value")
                parameters[key] = m[1] if m[1] is not None else m[2]
        steps.append((name, parameters))
        if not take("|+"):
            skip()
            if at < len(text):
                raise ScriptError("Expected '|+' or the end", at)
            return steps


def parse_color(text: str) -> int:
    m = re.fullmatch(r"#([0-9a-fA-F]{2})?([0-9a-fA-F]{6})", text)
    if not m:
        raise ValueError(f"Invalid color: {text!r}")
    return int(m[2], 16) << 8 | int(m[1] or "ff", 16)


def parse_scale(text: str) -> tuple[tuple[tuple[int, int], ...], int]:
    """h:#color;...;none:#color; heights must ascend."""
    marks, none = [], None
    for part in text.split(";"):
        key, colon, value = part.partition(":")
        if not colon:
            raise ValueError("invalid color scale")
        if key == "none":
            none = parse_color(value)
        else:
            marks.append((int(key), parse_color(value)))
    if none is None or not marks or [m[0] for m in marks] != sorted({m[0] for m in marks}):
        raise ValueError("invalid color scale")
    return tuple(marks), none


def scale_to_text(scale: tuple[tuple[int, int], ...], none: int) -> str:
    def hexed(c: int) -> str:
        rgb, a = c >> 8, c & 255
        return f"#{rgb:06x}" if a == 255 else f"#{a:02x}{rgb:06x}"

    return ";".join([*(f"{h}:{hexed(c)}" for h, c in scale), f"none:{hexed(none)}"])


def _scale(text: str) -> dict[str, Any]:
    scale, none = parse_scale(text)
    return {"scale": scale, "none": none}


# The parameters of each step.
STEPS: dict[str, dict[str, Any]] = {
    "elecolor": {"scale": _scale},
    "igor": {"sunaz": lambda v: {"azimuth": math.radians(float(v))}, "shadcol": lambda v: {"rgb": parse_color(v) >> 8 << 8}},
    "lambert": {"sunaz": lambda v: {"azimuth": math.radians(float(v))}, "sunalt": lambda v: {"altitude": math.radians(float(v))}, "shadcol": lambda v: {"rgb": parse_color(v) >> 8 << 8}},
    "slope": {"hcol": lambda v: {"horizontal": parse_color(v)}, "vcol": lambda v: {"vertical": parse_color(v)}},
    "aspect": {k: (lambda v, i=i: {i: parse_color(v)}) for i, k in enumerate(("ncol", "ecol", "scol", "wcol"))},
    "solid": {"color": lambda v: {"rgba": parse_color(v)}},
}


def build(text: str) -> Leaf | Composite:
    """The plan of a script: each step over the ones before it."""
    plan: Leaf | Composite | None = None
    for name, raw in parse_steps(text):
        if name not in STEPS:
            raise ValueError(f"Unrecognized shading step: '{name}'")
        parameters: dict[Any, Any] = {}
        for key, value in raw.items():
            if key not in STEPS[name]:
                raise ValueError(f"Unsupported parameter '{key}' of step '{name}'")
            parameters |= STEPS[name][key](value)
        if name == "aspect" and parameters:
            from ..functions.terrain import COMPASS

            parameters = {"compass": tuple(parameters.get(i, c) for i, c in enumerate(COMPASS))}
        leaf = Leaf(name, parameters)
        plan = leaf if plan is None else Composite(plan, leaf)
    return plan


def parse_projection(text: str, scale: projections.MapScale = projections.MapScale(50000, 300)) -> tuple[projections.Mercator | projections.LambertConformalConic, list[str]]:
    """+proj=merc or +proj=lcc +lat_1=...; the names of parameters that are not used come with it."""
    values: dict[str, str] = {}
    at = 0
    for token in text.split(" "):
        if token:
            m = re.fullmatch(r"\+([A-Za-z0-9_]+)(?:=(\S+))?", token)
            if not m:
                bad = 1 if token.startswith("+=") else 0 if not token.startswith("+") else len(token)
                raise ScriptError("Expected +name=value", at + bad)
            values[m[1]] = m[2] or ""
        at += len(token) + 1
    kind = values.pop("proj", None)
    if kind == "merc":
        return projections.Mercator(scale.factor), list(values)[::-1]
    if kind == "lcc":
        used = {"lat_0": "lat0", "lat_1": "lat1", "lat_2": "lat2", "lon_0": "lon0", "x_0": "x0", "y_0": "y0", "k_0": "k0"}
        given = {used[k]: float(values.pop(k)) for k in list(values) if k in used}
        given.setdefault("lat2", given.get("lat1", 0.0))
        given["ellipsoid"] = projections.ELLIPSOIDS[values.pop("ellps", "WGS84")]
        return projections.LambertConformalConic(scale=scale.per_meter, **given), list(values)[::-1]
    raise ValueError(f"Unsupported projection: {kind!r}")


OPAQUE_WHITE = color.literal(255, 255, 255)
