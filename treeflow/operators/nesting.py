"""Nesting trees for nested logit models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Nest:
    code: int
    name: str
    parameter: str | float | None = None
    children: list[int] = field(default_factory=list)


class NestingTree:
    """A rooted tree of alternatives (elementals) and nests. Nodes without a parent hang on the root, code 0."""

    ROOT = 0

    def __init__(self, alternatives: Mapping[int, str] | Iterable[str] = (), root_parameter: str | float | None = None):
        named = dict(alternatives) if isinstance(alternatives, Mapping) else dict(enumerate(alternatives, 1))
        self.names: dict[int, str] = dict(named)
        self.nests: dict[int, Nest] = {self.ROOT: Nest(self.ROOT, "_root_", root_parameter)}

    # --- building ---

    def add_node(self, code: int, children: Iterable[int] = (), *, name: str | None = None, parameter: str | float | None = None) -> int:
        children = list(children)
        if code in self.names or code in self.nests:
            raise ValueError(f"code {code} is taken")
        for c in children:
            self._free(c)
        self.nests[code] = Nest(code, name or str(code), parameter, children)
        return code

    def new_node(self, children: Iterable[int] = (), **options: Any) -> int:
        return self.add_node(max([*self.names, *self.nests], default=0) + 1, children, **options)

    def add_edge(self, up: int, down: int) -> None:
        self._free(down)
        self.nests[up].children.append(down)

    def remove_edge(self, up: int, down: int) -> None:
        self.nests[up].children.remove(down)

    def remove_node(self, code: int) -> None:
        if code == self.ROOT:
            raise ValueError("the root stays")
        for n in self.nests.values():
            if code in n.children:
                n.children.remove(code)
        self.nests.pop(code, None)
        self.names.pop(code, None)

    def _free(self, code: int) -> None:
        if any(code in n.children for n in self.nests.values()):
            raise ValueError(f"{code} has a parent; nodes have one each")

    # --- asking ---

    @property
    def elementals(self) -> list[int]:
        return sorted(self.names)

    def children(self, code: int) -> list[int]:
        held = self.nests[code].children
        if code != self.ROOT:
            return list(held)
        below = {c for n in self.nests.values() for c in n.children}
        return [*held, *sorted(c for c in [*self.names, *self.nests] if c not in below and c != self.ROOT)]

    def parent(self, code: int) -> int | None:
        return None if code == self.ROOT else next((n for n in self.nests if n != self.ROOT and code in self.nests[n].children), self.ROOT)

    def name_of(self, code: int) -> str:
        return self.names.get(code) or self.nests[code].name

    def bottom_up(self) -> list[int]:
        """Nests, each after all nests below it; of those that could come next the largest code last."""
        left, done = set(self.nests), []
        while left:
            ready = sorted(n for n in left if not any(c in left for c in self.children(n)))
            if not ready:
                raise ValueError("nests form a circle")
            done.append(ready[0])
            left.discard(ready[0])
        return done

    topological_sorted = bottom_up

    def subgraph_from(self, code: int) -> NestingTree:
        below, queue = {code}, [code]
        while queue:
            for c in self.children(queue.pop()):
                if c not in below:
                    below.add(c)
                    if c in self.nests:
                        queue.append(c)
        out = NestingTree({c: n for c, n in self.names.items() if c in below}, self.nests[code].parameter)
        for c in below - {code}:
            if c in self.nests:
                out.nests[c] = Nest(c, self.nests[c].name, self.nests[c].parameter, list(self.nests[c].children))
        return out

    def parameter(self, code: int, parameters: Mapping[str, float] | None = None) -> float:
        p = self.nests[code].parameter
        if p is None:
            return 1.0
        return float((parameters or {})[p]) if isinstance(p, str) else float(p)

    def as_arrays(self, parameters: Mapping[str, float] | None = None) -> dict[str, Any]:
        """Slots: alternatives first, then nests bottom-up; edges by nest, and each nest's parameter."""
        nests = self.bottom_up()
        slot = {c: i for i, c in enumerate([*self.elementals, *nests])}
        up, down, start, size = [], [], [], []
        for n in nests:
            kids = sorted(self.children(n), key=slot.__getitem__)
            start.append(len(up))
            size.append(len(kids))
            up += [slot[n]] * len(kids)
            down += [slot[k] for k in kids]
        return {
            "n_nodes": len(slot), "n_alts": len(self.names), "edges_up": up, "edges_dn": down, "edges_1st": [i in set(start) for i in range(len(up))], "edges_alloc": [1.0] * len(up),
            "mu_params": [self.parameter(n, parameters) for n in nests], "start_slots": start, "len_slots": size,
        }

    def to_dict(self) -> dict[str, Any]:
        return {"alternatives": dict(self.names), "nests": [{"code": n.code, "name": n.name, "parameter": n.parameter, "children": list(n.children)} for n in self.nests.values()]}

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> NestingTree:
        out = cls({int(k): v for k, v in d["alternatives"].items()})
        for n in d["nests"]:
            out.nests[n["code"]] = Nest(n["code"], n["name"], n.get("parameter"), list(n["children"]))
        return out

    def description(self) -> str:
        lines: list[str] = []

        def tell(code: int, depth: int) -> None:
            extra = f" ({self.nests[code].parameter})" if code in self.nests and self.nests[code].parameter is not None else ""
            lines.append("  " * depth + self.name_of(code) + extra)
            for c in self.children(code) if code in self.nests else ():
                tell(c, depth + 1)

        tell(self.ROOT, 0)
        return "\n".join(lines)

    def copy(self) -> NestingTree:
        return self.from_dict(self.to_dict())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, NestingTree) and self.to_dict() == other.to_dict()

    __hash__ = None  # type: ignore[assignment]


def construct_nesting_tree(alternatives: Iterable[str], nests: Mapping[str, Any]) -> NestingTree:
    """From settings: {name, coefficient, alternatives: [names or further settings]}; the outermost is the root."""
    tree = NestingTree(list(alternatives))
    code_of = {n: c for c, n in tree.names.items()}

    def made(settings: Mapping[str, Any], root: bool) -> int:
        kids = []
        for a in settings["alternatives"]:
            if isinstance(a, Mapping):
                kids.append(made(a, False))
            elif a in code_of:
                kids.append(code_of[a])
            else:
                raise KeyError(a)
        if root:
            tree.nests[tree.ROOT] = Nest(tree.ROOT, settings["name"], settings.get("coefficient"), kids)
            return tree.ROOT
        return tree.new_node(kids, name=settings["name"], parameter=settings.get("coefficient"))

    made(dict(nests), True)
    return tree
