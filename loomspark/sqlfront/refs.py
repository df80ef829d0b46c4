"""References between models: `{{ ref('name') }}` and `$ref(name)`."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

REF = re.compile(r"""\{\{-?\s*ref\(\s*(?P<q>['"])(?P<a>.+?)(?P=q)\s*\)\s*-?\}\}|\$ref\(\s*(?P<r>['"]?)(?P<b>[^)'"]+?)(?P=r)\s*\)""")


def extract_refs(sql: str) -> list[str]:
    """Names in order of appearance, each once; comments count too."""
    return list(dict.fromkeys(m["a"] or m["b"].strip() for m in REF.finditer(sql)))


def render_refs(sql: str, resolve: Mapping[str, str] | Callable[[str], str] | None = None) -> str:
    """References replaced by what resolve gives; a name that it lacks stays bare."""

    def put(m: re.Match) -> str:
        name = m["a"] or m["b"].strip()
        if resolve is None:
            return name
        return resolve(name) if callable(resolve) else resolve.get(name, name)

    return REF.sub(put, sql)
