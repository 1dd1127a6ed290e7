"""Operations on one JSON entity of any depth, as plain functions of decoded values.

Numbers are doubles throughout, as in the entities' own data model.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

from weftline.functions.scalars import canonical, value_text

_GONE = object()


def decode(text: str | None):
    """The value of a JSON text, with numbers as doubles; None where it isn't JSON."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_int=float)
    except ValueError:
        return None


def denull(v):
    """Without nulls and blank strings; arrays left empty go, objects left empty stay. _GONE if nothing is left."""
    if isinstance(v, dict):
        kept = ((k, denull(x)) for k, x in v.items() if x is not None)
        return {k: x for k, x in kept if x is not _GONE}
    if isinstance(v, list):
        kept = [x for x in (denull(x) for x in v if x is not None) if x is not _GONE]
        return kept or _GONE
    return _GONE if v is None or (isinstance(v, str) and not v.strip()) else v


def values_at(v, path: str) -> list:
    """The values a dot path leads to; arrays on the way fan out, one at its end is a value."""
    here = [v]
    for key in path.split("."):
        nxt = []
        while here:
            x = here.pop(0)
            if isinstance(x, list):
                here[:0] = x
            elif isinstance(x, dict) and key in x:
                nxt.append(x[key])
        here = nxt
    return here


def trie(paths: Iterable[str]) -> dict:
    """Nested dicts of path parts; None marks an end, which rules out whatever is deeper."""
    root: dict = {}
    for path in paths:
        at = root
        *way, last = path.split(".")
        for part in way:
            at = at.setdefault(part, {})
            if at is None:
                break
        else:
            at[last] = None
    return root


def keep(v, tree: dict | None):
    """Only what the tree's paths lead to. Scalars met on the way stay whole, nulls go."""
    if tree is None or not isinstance(v, (dict, list)):
        return v
    if isinstance(v, list):
        return [x for x in (keep(x, tree) for x in v) if x is not None]
    return {k: x for k, x in ((k, keep(v[k], sub)) for k, sub in tree.items() if k in v) if x is not None}


def drop(v, tree: dict | None):
    """Without what the tree's paths lead to, nor nulls on their way."""
    if tree is None:
        return None
    if isinstance(v, list):
        return [x for x in (drop(x, tree) for x in v) if x is not None]
    if isinstance(v, dict):
        return {k: x for k, x in ((k, drop(x, tree[k]) if k in tree else x) for k, x in v.items()) if k not in tree or x is not None}
    return v


def leaves(v) -> Iterator[str]:
    """The display forms of all values that are neither null nor containers, keys in order."""
    if isinstance(v, dict):
        for k in sorted(v):
            yield from leaves(v[k])
    elif isinstance(v, list):
        for x in v:
            yield from leaves(x)
    elif v is not None:
        yield value_text(v)


def flatten(entity: dict, skip: str | None = None) -> dict:
    """One level: names joined by _, objects in arrays by their place, other arrays as JSON. skip: a key left out at all depths."""
    out: dict = {}

    def place(key: str, v) -> None:
        if isinstance(v, dict):
            for k in sorted(v):
                if k != skip:
                    place(f"{key}_{k}", v[k])
        elif isinstance(v, list):
            if any(isinstance(x, dict) for x in v):
                for i, x in enumerate(v):
                    if isinstance(x, dict):
                        place(f"{key}_{i}", x)
                    else:
                        out[f"{key}_{i}"] = x
            else:
                out[key] = canonical(v)
        else:
            out[key] = v

    for k in sorted(entity):
        if k != skip:
            place(k, entity[k])
    return out


def entity_hash(entity: dict, keys: Iterable[str] | None = None) -> str:
    """SHA-256 over keys and values: of the given keys, missing as null, or of all but _source."""
    names = sorted(k for k in entity if k != "_source") if keys is None else list(keys)
    return hashlib.sha256("".join(f"{k}|{canonical(entity.get(k))}" for k in names).encode()).hexdigest()


def matches(entity: dict, path: str, wanted: str, part: bool) -> bool:
    """Whether any value at path equals wanted, or holds it, in lower case."""
    found = (value_text(x).lower() for x in values_at(entity, path))
    return any(wanted in x for x in found) if part else any(wanted == x for x in found)


def has_keywords(entity: dict, words: list[str], every: bool) -> bool:
    text = " ".join(leaves(entity)).lower()
    return (all if every else any)(w in text for w in words)
