"""What Python sources say: imports, calls, attributes, constants and loaded libraries."""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass
from functools import cached_property

from granary.extract.archive import Archive

SOURCE_BYTES = 8 << 20
#: Loaders of shared libraries, and the constructors whose algorithm is an argument.
LOADERS = {"ctypes.CDLL", "ctypes.cdll.LoadLibrary", "ctypes.util.find_library", "ctypes.PyDLL"}


@dataclass
class Targets:
    """What the policy watches for."""

    modules: list[str]
    calls: set[str]
    attributes: set[str]
    constants: set[str]
    libraries: list[str]

    @cached_property
    def words(self) -> re.Pattern[bytes]:
        """Words of which a source must have one to say anything."""
        roots = {x.split(".")[0] for x in [*self.modules, *LOADERS]} | {x.rsplit(".", 1)[-1] for x in self.calls if x.startswith("*.")} | {x.split(".")[0] for x in self.calls | self.constants}
        return re.compile(b"|".join(re.escape(x.encode()) for x in sorted((roots - {"*"}) | self.attributes)))

    def may_speak(self, data: bytes) -> bool:
        """False only for sources without any of the words; other than ASCII letters can be
        spellings of the same names."""
        return not data.isascii() or b"coding" in data[:400] or self.words.search(data) is not None


def scan(a: Archive, t: Targets) -> list[dict]:
    out: dict[tuple, dict] = {}
    for name in sorted(a.members):
        m = a.members[name]
        if not name.endswith(".py") or m.is_symlink:
            continue
        fail = lambda kind, message, name=name: a.error(kind, name, message, "python")
        if m.size > SOURCE_BYTES:
            fail("python_too_large", f"{m.size} bytes")
            continue
        before = len(a.errors)
        data = a.read(name)
        if data is None:
            a.errors[before:] = [("python", *e[1:]) for e in a.errors[before:]]
            continue
        try:
            if b"\0" in data:
                raise SyntaxError("NUL byte")
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(data)
            sites = _Visitor(name, t).run(tree) if t.may_speak(data) else []
        except UnicodeDecodeError:
            fail("python_decode_error", "cannot be decoded")
        except (SyntaxError, ValueError) as e:
            fail("python_decode_error" if "decode" in str(e) or "encoding" in str(e) else "python_syntax_error", f"line {getattr(e, 'lineno', None) or 0}")
        except (RecursionError, MemoryError):
            fail("python_recursion_limit_exceeded", "nested too deeply")
        else:
            for s in sites:
                out.setdefault((s["kind"], s["path"], s["line"], s["target"], tuple(sorted(s["attrs"].items()))), s)
    return sorted(out.values(), key=lambda s: (s["kind"], s["path"], s["line"], s["target"]))


_IMPORTS, _ASSIGNS, _NAMES = (ast.Import, ast.ImportFrom), (ast.Assign, ast.AnnAssign, ast.AugAssign), (ast.Name, ast.Attribute)
#: Fields of a node that may hold others that matter, by kind of node.
_FIELDS: dict[type, tuple[str, ...]] = {}


def _nodes(tree: ast.AST) -> list[ast.AST]:
    """All nodes but contexts and operators, level by level."""
    out = [tree]
    for n in out:
        kind = type(n)
        if kind not in _FIELDS:
            _FIELDS[kind] = tuple(f for f in n._fields if f not in ("ctx", "op", "ops"))
        for f in _FIELDS[kind]:
            v = getattr(n, f, None)
            if type(v) is list:
                out += [x for x in v if isinstance(x, ast.AST)]
            elif isinstance(v, ast.AST):
                out.append(v)
    return out


def _clip(x: str, n: int = 200) -> str:
    return "".join(c if " " <= c <= "~" else "?" for c in x)[:n]


class _Visitor:
    def __init__(self, path: str, t: Targets):
        self.path, self.t, self.sites, self.alias, self.claimed = path, t, [], {}, set()

    def run(self, tree: ast.AST) -> list[dict]:
        nodes = _nodes(tree)
        for n in nodes:
            if type(n) is ast.Import:
                for x in n.names:
                    self.alias[x.asname or x.name.split(".")[0]] = x.name if x.asname else x.name.split(".")[0]
            elif type(n) is ast.ImportFrom and n.module:
                self.alias |= {x.asname or x.name: f"{n.module}.{x.name}" for x in n.names if x.name != "*"}
        handlers = {ast.Call: self.calls} | dict.fromkeys(_IMPORTS, self.imports) | dict.fromkeys(_ASSIGNS, self.assigns)
        for n in nodes:
            if f := handlers.get(type(n)):
                f(n)
        last = {x.rsplit(".", 1)[-1] for x in self.t.constants}  # no name ends so, no constant
        last |= {k for k, v in self.alias.items() if v in self.t.constants}
        for n in nodes:
            if type(n) in _NAMES and (n.attr if type(n) is ast.Attribute else n.id) in last and type(n.ctx) is ast.Load and n not in self.claimed and (d := self.name(n)) in self.t.constants:
                self.site(n, "py_constant", d, d)
        return self.sites

    def site(self, node: ast.AST, kind: str, target: str, detail: str, **attrs: str) -> None:
        self.sites.append({"path": self.path, "line": node.lineno, "kind": kind, "target": target, "detail": _clip(detail), "attrs": attrs})

    def name(self, node: ast.AST) -> str | None:
        """a.b.c with its root resolved through the imports."""
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return None
        return ".".join([self.alias.get(node.id, node.id), *reversed(parts)])

    def module(self, dotted: str) -> str | None:
        return next((m for m in self.t.modules if dotted == m or dotted.startswith(f"{m}.")), None)

    def imports(self, n: ast.Import | ast.ImportFrom) -> None:
        if isinstance(n, ast.ImportFrom):
            names = [(f"{n.module}.{x.name}", f"from {n.module} import {x.name}") for x in n.names] if n.module else []
        else:
            names = [(x.name, f"import {x.name}" + (f" as {x.asname}" if x.asname else "")) for x in n.names]
        for dotted, detail in names:
            if m := self.module(dotted):
                self.site(n, "py_import", m, detail)

    def assigns(self, n) -> None:
        targets = list(n.targets) if isinstance(n, ast.Assign) else [n.target]
        while targets:
            x = targets.pop(0)
            if isinstance(x, (ast.Tuple, ast.List)):
                targets += x.elts
                continue
            if isinstance(x, ast.Starred):
                targets.append(x.value)
                continue
            attr = x.attr if isinstance(x, ast.Attribute) else x.id if isinstance(x, ast.Name) else None
            if attr not in self.t.attributes or n.value is None:
                continue
            v = n.value
            value = str(v.value) if isinstance(v, ast.Constant) else self.name(v) or "unresolved"
            if isinstance(v, (ast.Name, ast.Attribute)):
                self.claimed.add(v)
            sign = "=" if not isinstance(n, ast.AugAssign) else {ast.BitOr: "|=", ast.BitAnd: "&=", ast.BitXor: "^="}.get(type(n.op), "op=")
            self.site(n, "py_attr", attr, f"{attr} {sign} {value}", value=value)

    def calls(self, n: ast.Call) -> None:
        target = self.name(n.func)
        last = target.rsplit(".", 1)[-1] if target else n.func.attr if isinstance(n.func, ast.Attribute) else None
        hit = target if target in self.t.calls else f"*.{last}" if last and f"*.{last}" in self.t.calls and isinstance(n.func, ast.Attribute) else None
        if hit:
            attrs = self.hashing(target, n) if target and target.startswith("hashlib.") else {}
            shown = f"{target or hit}(" + ", ".join(f"{k}={v}" for k, v in sorted(attrs.items())) + ")"
            self.site(n, "py_call", hit, shown, **attrs)
        if target in LOADERS and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
            for lib in self.t.libraries:
                if lib in n.args[0].value:
                    self.site(n, "py_ctypes_load", lib, f"{target}({n.args[0].value!r})")

    @staticmethod
    def hashing(target: str, n: ast.Call) -> dict[str, str]:
        algorithm = target.rsplit(".", 1)[-1]
        if algorithm == "new":
            x = n.args[0] if n.args else None
            algorithm = x.value.lower() if isinstance(x, ast.Constant) and isinstance(x.value, str) else "unresolved"
        used = "absent"
        for k in n.keywords:
            if k.arg is None:
                used = "unresolved"
            elif k.arg == "usedforsecurity":
                used = str(k.value.value).lower() if isinstance(k.value, ast.Constant) and isinstance(k.value.value, bool) else "unresolved"
                break
        return {"algorithm": algorithm, "usedforsecurity": used}
