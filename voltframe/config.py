"""Nested parameters with defaults: unknown names are an error, are split off or are merged in; nested forms flatten and compare."""

from __future__ import annotations


def parse(defaults: dict, given: dict, unknown: str = "error") -> tuple[dict, dict]:
    """Defaults overridden by given values, deeply, and what is unknown (with unknown="split")."""
    if unknown not in ("error", "split", "merge"):
        raise ValueError("unknown is error, split or merge")
    out, rest = dict(defaults), {}
    for name, value in given.items():
        if name not in defaults and unknown == "error":
            raise KeyError(f"unknown parameter {name}")
        if name not in defaults and unknown == "split":
            rest[name] = value
        elif isinstance(defaults.get(name), dict) and isinstance(value, dict):
            out[name], more = parse(defaults[name], value, unknown)
            if more:
                rest[name] = more
        else:
            out[name] = value
    return out, rest


def flatten(nested: dict, prefix: str = "") -> dict:
    """Names joined by dots."""
    out = {}
    for name, value in nested.items():
        out |= flatten(value, f"{prefix}{name}.") if isinstance(value, dict) else {prefix + name: value}
    return out


def differences(a: dict, b: dict) -> dict:
    """Flat names whose values differ: (value in a, value in b), None where there is none."""
    x, y = flatten(a), flatten(b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)}
