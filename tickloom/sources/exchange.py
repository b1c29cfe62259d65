"""Exchange REST calls, made on the driver; parsing is Spark's."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from difflib import get_close_matches
from pathlib import Path


def call(url: str, fetch: Callable[[str], str]) -> dict:
    """The ``result`` of a call; errors of the network or the exchange raise RuntimeError."""
    try:
        answer = json.loads(fetch(url))
    except (OSError, ValueError) as e:
        raise RuntimeError(f"no answer from {url}: {e}") from e
    if answer.get("error"):
        raise RuntimeError(f"exchange error: {', '.join(answer['error'])}")
    return answer.get("result", {})


def fetch_tickers(pairs: Sequence[str], url: str, fetch: Callable[[str], str], chunk: int = 100) -> dict:
    """Ticker entries of all pairs, asked for in chunks; of a repeated key the last answer counts."""
    found: dict = {}
    for at in range(0, len(pairs), chunk):
        found.update(call(f"{url}?pair={','.join(pairs[at : at + chunk])}", fetch))
    return found


def resolve_path(name: str, folder: str = ".") -> str:
    """A file by its exact name, then in any case, then by likeness (0.6 or more); FileNotFoundError names candidates."""
    wanted = Path(folder, name)
    if wanted.exists():
        return str(wanted)
    here = sorted(p.name for p in wanted.parent.glob("*")) if wanted.parent.is_dir() else []
    same = [x for x in here if x.lower() == wanted.name.lower()]
    near = same or get_close_matches(wanted.name, here, n=3, cutoff=0.6)
    if near:
        return str(wanted.parent / near[0])
    raise FileNotFoundError(f"{wanted}; present: {', '.join(here[:10]) or 'nothing'}")
