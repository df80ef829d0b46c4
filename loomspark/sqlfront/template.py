"""Templates: expressions, if, for, set and macros over a whitelisted grammar; nothing is evaluated as Python.

Undefined names are errors. `ref(...)` passes through unchanged, for the reference resolver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any


class TemplateError(ValueError):
    """A template that can't be parsed or that uses an unknown name."""


_PIECES = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#-?.*?-?#\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+*/%~|.,:()\[\]{}<>=]))", re.DOTALL)
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}

FILTERS: dict[str, Callable[..., Any]] = {
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "trim": lambda x: str(x).strip(),
    "length": len,
    "join": lambda x, sep="": sep.join(map(str, x)),
    "replace": lambda x, a, b: str(x).replace(a, b),
    "int": int,
    "float": float,
    "string": str,
    "list": list,
    "first": lambda x: next(iter(x)),
    "last": lambda x: list(x)[-1],
    "sort": sorted,
    "round": lambda x, n=0: round(x, n),
}


class _Undefined:
    def __init__(self, name: str):
        self.name = name


class _Expression:
    """Recursive descent over one expression's tokens, evaluated as it goes."""

    def __init__(self, text: str, scope: Mapping[str, Any]):
        self.text, self.scope, self.tokens, self.at = text, scope, [], 0
        end = 0
        text = text.rstrip()
        while end < len(text):
            m = _TOKEN.match(text, end)
            if not m or m.end() == end:
                raise TemplateError(f"can't read {text[end:]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            end = m.end()

    def value(self) -> Any:
        out = self._settled(self._ternary())
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def _peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in texts

    def _take(self, *texts: str) -> bool:
        found = self._peek(*texts)
        self.at += found
        return found

    def _need(self, text: str) -> None:
        if not self._take(text):
            raise TemplateError(f"{text!r} is missing in {self.text!r}")

    def _settled(self, x: Any) -> Any:
        if isinstance(x, _Undefined):
            raise TemplateError(f"{x.name!r} is undefined")
        return x

    def _ternary(self) -> Any:
        out = self._or()
        if self._take("if"):
            test = self._truth(self._or())
            other = self._ternary() if self._take("else") else ""
            return out if test else other
        return out

    def _truth(self, x: Any) -> bool:
        return bool(self._settled(x))

    def _or(self) -> Any:
        out = self._and()
        while self._take("or"):
            right = self._and()
            out = self._settled(out) or right
        return out

    def _and(self) -> Any:
        out = self._not()
        while self._take("and"):
            right = self._not()
            out = self._settled(out) and right
        return out

    def _not(self) -> Any:
        return not self._truth(self._not()) if self._take("not") else self._compare()

    def _compare(self) -> Any:
        out = self._sum()
        while True:
            if self._take("is"):
                negative = self._take("not")
                kind = self._name()
                if kind not in ("defined", "none", "undefined"):
                    raise TemplateError(f"unknown test {kind!r}")
                if kind == "none":
                    found = not isinstance(out, _Undefined) and out is None
                else:
                    found = isinstance(out, _Undefined) == (kind == "undefined")
                out = found != negative
            elif self._peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                out = self._settled(out) not in self._settled(self._sum())
            elif self._take("in"):
                out = self._settled(out) in self._settled(self._sum())
            elif self._peek("==", "!=", "<", ">", "<=", ">="):
                op = self.tokens[self.at][1]
                self.at += 1
                a, b = self._settled(out), self._settled(self._sum())
                out = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}[op]()
            else:
                return out

    def _sum(self) -> Any:
        out = self._product()
        while self._peek("+", "-", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            a, b = self._settled(out), self._settled(self._product())
            out = f"{_shown(a)}{_shown(b)}" if op == "~" else a + b if op == "+" else a - b
        return out

    def _product(self) -> Any:
        out = self._unary()
        while self._peek("*", "/", "//", "%"):
            op = self.tokens[self.at][1]
            self.at += 1
            a, b = self._settled(out), self._settled(self._unary())
            out = {"*": lambda: a * b, "/": lambda: a / b, "//": lambda: a // b, "%": lambda: a % b}[op]()
        return out

    def _unary(self) -> Any:
        return -self._settled(self._unary()) if self._take("-") else self._filtered()

    def _filtered(self) -> Any:
        out = self._postfix()
        while self._take("|"):
            name, args, named = self._name(), [], {}
            if self._take("("):
                args, named = self._arguments()
            if name in ("default", "d"):
                out = args[0] if isinstance(out, _Undefined) else out
            elif name in FILTERS:
                out = FILTERS[name](self._settled(out), *args, **named)
            else:
                raise TemplateError(f"unknown filter {name!r}")
        return out

    def _name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"a name is missing in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _arguments(self) -> tuple[list, dict]:
        args, named = [], {}
        while not self._take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1][1] == "=":
                name = self._name()
                self.at += 1
                named[name] = self._settled(self._ternary())
            else:
                args.append(self._settled(self._ternary()))
            if not self._peek(")"):
                self._need(",")
        return args, named

    def _postfix(self) -> Any:
        out = self._atom()
        while True:
            if self._take("."):
                name, holder = self._name(), self._settled(out)
                if not isinstance(holder, Mapping):
                    raise TemplateError(f"{name!r} of a {type(holder).__name__} is not to be had")
                out = holder[name] if name in holder else _Undefined(name)
            elif self._take("["):
                key, holder = self._settled(self._ternary()), self._settled(out)
                self._need("]")
                try:
                    out = holder[key]
                except (KeyError, IndexError):
                    out = _Undefined(str(key))
            elif self._take("("):
                args, named = self._arguments()
                call = self._settled(out)
                if not callable(call):
                    raise TemplateError(f"{self.text!r}: not a function")
                out = call(*args, **named)
            else:
                return out

    def _atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.text!r} ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "string":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
        if kind == "name":
            if text.lower() in ("true", "false", "none"):
                return {"true": True, "false": False, "none": None}[text.lower()]
            if text in _WORDS:
                raise TemplateError(f"unexpected {text!r} in {self.text!r}")
            return self.scope[text] if text in self.scope else _Undefined(text)
        if text == "(":
            out = self._ternary()
            self._need(")")
            return out
        if text == "[":
            out = []
            while not self._take("]"):
                out.append(self._settled(self._ternary()))
                if not self._peek("]"):
                    self._need(",")
            return out
        if text == "{":
            found = {}
            while not self._take("}"):
                key = self._settled(self._ternary())
                self._need(":")
                found[key] = self._settled(self._ternary())
                if not self._peek("}"):
                    self._need(",")
            return found
        raise TemplateError(f"unexpected {text!r} in {self.text!r}")


def _shown(x: Any) -> str:
    return "" if x is None else str(x)


def _evaluate(text: str, scope: Mapping[str, Any]) -> Any:
    return _Expression(text, scope).value()


class Template:
    def __init__(self, text: str):
        parts = _PIECES.split(text)
        for i in range(1, len(parts), 2):  # white space next to a dash goes
            if parts[i][2] == "-":
                parts[i - 1] = parts[i - 1].rstrip()
            if parts[i][-3] == "-":
                parts[i + 1] = parts[i + 1].lstrip()
        self.parts, self.at = parts, 0
        self.body = self._block(())
        if self.at < len(parts):
            raise TemplateError(f"unexpected {parts[self.at]}")

    def _block(self, ends: tuple[str, ...]) -> list[tuple]:
        out: list[tuple] = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            if self.at % 2 == 0:
                if part:
                    out.append(("text", part))
            elif part.startswith("{{"):
                out.append(("value", part[2:-2].strip("-").strip()))
            elif part.startswith("{%"):
                inner = part[2:-2].strip("-").strip()
                word = inner.split(None, 1)[0] if inner else ""
                if word in ends:
                    return out
                self.at += 1
                out.append(self._tag(word, inner[len(word) :].strip(), part))
                continue
            self.at += 1
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return out

    def _word(self) -> tuple[str, str]:
        inner = self.parts[self.at][2:-2].strip("-").strip()
        self.at += 1
        word, _, rest = inner.partition(" ")
        return word, rest.strip()

    def _tag(self, word: str, rest: str, part: str) -> tuple:
        if word == "if":
            tests, other, test = [], [], rest
            while True:
                body = self._block(("elif", "else", "endif"))
                if test is None:
                    other = body
                else:
                    tests.append((test, body))
                end, test = self._word()
                if end == "endif":
                    return "if", tests, other
                test = test if end == "elif" else None
        if word == "for":
            m = re.fullmatch(r"(\w+(?:\s*,\s*\w+)*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"can't read {part}")
            body = self._block(("endfor",))
            self._word()
            return "for", [x.strip() for x in m[1].split(",")], m[2], body
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq:
                raise TemplateError(f"can't read {part}")
            return "set", name.strip(), value.strip()
        if word == "macro":
            m = re.fullmatch(r"(\w+)\s*\((.*)\)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"can't read {part}")
            body = self._block(("endmacro",))
            self._word()
            names = [(a.strip(), d.strip() if e else None) for a, e, d in (x.partition("=") for x in m[2].split(",") if x.strip())]
            return "macro", m[1], names, body
        raise TemplateError(f"unknown tag {part}")

    def render(self, scope: Mapping[str, Any]) -> str:
        return self._run(self.body, dict(scope))

    def macros(self, scope: Mapping[str, Any]) -> dict[str, Callable[..., str]]:
        inner = dict(scope)
        self._run(self.body, inner)
        return {node[1]: inner[node[1]] for node in self.body if node[0] == "macro"}

    def _run(self, body: list[tuple], scope: dict[str, Any]) -> str:
        out = []
        for node in body:
            kind = node[0]
            if kind == "text":
                out.append(node[1])
            elif kind == "value":
                out.append(_shown(_evaluate(node[1], scope)))
            elif kind == "if":
                chosen = next((b for test, b in node[1] if _evaluate(test, scope)), node[2])
                out.append(self._run(chosen, scope))
            elif kind == "for":
                items = list(_evaluate(node[2], scope))
                for i, item in enumerate(items):
                    names = dict(zip(node[1], item, strict=True)) if len(node[1]) > 1 else {node[1][0]: item}
                    loop = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                    out.append(self._run(node[3], {**scope, **names, "loop": loop}))
            elif kind == "set":
                scope[node[1]] = _evaluate(node[2], scope)
            elif kind == "macro":
                scope[node[1]] = self._macro(node, scope)
        return "".join(out)

    def _macro(self, node: tuple, scope: dict[str, Any]) -> Callable[..., str]:
        _, name, params, body = node

        def call(*args: Any, **named: Any) -> str:
            inner = dict(scope)
            for i, (param, default) in enumerate(params):
                if i < len(args):
                    inner[param] = args[i]
                elif param in named:
                    inner[param] = named[param]
                elif default is not None:
                    inner[param] = _evaluate(default, scope)
                else:
                    raise TemplateError(f"{name}() lacks {param!r}")
            return self._run(body, inner)

        return call


def helpers(variables: Mapping[str, Any]) -> dict[str, Any]:
    missing = object()

    def var(key: str, default: Any = missing) -> Any:
        if key in variables:
            return variables[key]
        if default is missing:
            raise TemplateError(f"variable {key!r} is undefined and has no default")
        return default

    return {**variables, "var": var, "ref": lambda name: "{{ ref('" + name + "') }}"}


def render(text: str, variables: Mapping[str, Any], macros: Mapping[str, Any] | None = None, **more: Any) -> str:
    return Template(text).render({**helpers(variables), **(macros or {}), **more})


def load_macros(folder: Path, variables: Mapping[str, Any]) -> dict[str, Callable[..., str]]:
    """Macros of all .sql files below the folder; they may call var(), ref() and each other."""
    files = sorted(folder.rglob("*.sql")) if folder.is_dir() else []
    if not files:
        return {}
    return Template("\n".join(f.read_text() for f in files)).macros(helpers(variables))
