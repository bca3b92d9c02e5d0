"""Formula graphs: named data columns, and formulas that estimate some of them from others.

A graph is plain metadata. ``compute`` turns it into columns of a DataFrame (see ``compile``); it can also be
written as a specification, read back, taken apart, united with others or nested as a model of another graph.
"""

from __future__ import annotations

import copy
import heapq
import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An infinitely long way: ``far(a, b)`` is compared by ``a`` first. Distances are doubles; ``b`` stays below this unit.
FAR = float(1 << 30)
#: Name of the virtual source of given values, and of outputs that nobody needs.
START, SINK = "START", "SINK"


def far(times: float, rest: float = 0.0) -> float:
    """A distance that any number of ordinary steps can't reach (for values of last resort)."""
    return times * FAR + rest


@dataclass(frozen=True)
class Data:
    """A data column. ``merge`` waits for all estimations and gets ``{producer: Column}``; ``filters`` follow each other."""

    name: str
    default: object = None
    distance: float = 0.0
    merge: Callable[[dict[str, Column]], Column] | None = None
    filters: tuple[Callable[[Column], Column], ...] = ()
    weight: float = 0.0
    dtype: str | None = None
    wildcard: bool = True
    description: str = ""


@dataclass(frozen=True)
class Formula:
    """A formula: ``build(*inputs)`` gives a Column, or one for each output. It needs all inputs; NULL means it failed."""

    name: str
    build: Callable[..., Column | tuple[Column, ...]] | str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    domain: Callable[..., Column] | str | None = None
    weight: float = 0.0
    input_weights: dict[str, float] = field(default_factory=dict)
    output_weights: dict[str, float] = field(default_factory=dict)
    filters: tuple[Callable[[Column], Column], ...] = ()
    description: str = ""

    def input_length(self, source: str) -> float:
        return self.input_weights.get(source, 1.0) + self.weight

    def output_length(self, target: Data) -> float:
        return self.output_weights.get(target.name, 1.0) + target.weight


def _unused(name: str, taken: Iterable[str]) -> str:
    taken = set(taken)
    if name not in taken:
        return name
    n = 0
    while f"{name}<{n}>" in taken:
        n += 1
    return f"{name}<{n}>"


def _names(x: str | Iterable[str] | None) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


class FormulaGraph:
    """A set of data columns and formulas. The verbs change the graph and return the names they gave.

    Negative weights need ``negative_weights``: a shortest way then is the least sum, whichever column is settled first, and a
    way round that gets shorter each time is an error when the graph is compiled.
    """

    def __init__(self, name: str = "", description: str = "", negative_weights: bool = False):
        self.name, self.description, self.negative_weights = name, description, negative_weights
        self.data_nodes: dict[str, Data] = {}
        self.formulas: dict[str, Formula] = {}
        #: Domains of nested models: name -> (domain, the columns that it gets).
        self.guards: dict[str, tuple[Callable, tuple[str, ...]]] = {}

    def copy(self) -> FormulaGraph:
        out = copy.copy(self)
        out.data_nodes, out.formulas, out.guards = dict(self.data_nodes), dict(self.formulas), dict(self.guards)
        return out

    def data(self, name: str | None = None, **facts) -> str:
        """Declare a data column, or more about one: default, distance, merge, filters, weight, dtype, description."""
        name = _unused("unknown", [*self.data_nodes, *self.formulas]) if name is None else name
        if name in self.formulas:
            raise ValueError(f"{name!r} is a formula")
        if "filters" in facts:
            facts["filters"] = tuple(facts["filters"])
        self.data_nodes[name] = replace(self.data_nodes.get(name, Data(name)), **facts)
        return name

    def formula(self, build, inputs=None, outputs=None, name: str | None = None, **facts) -> str:
        """Declare a formula by a Column builder or SQL text over the inputs' names.

        Inputs default to the builder's parameters, whose defaults become default values of the data columns.
        Without outputs its result goes to ``SINK``. A name that is taken gets a number.
        """
        if inputs is None and callable(build):
            parameters = inspect.signature(build).parameters.values()
            inputs = [p.name for p in parameters]
            for p in parameters:
                if p.default is not p.empty:
                    self.data(p.name, default=p.default)
        inputs, outputs = _names(inputs), _names(outputs) or (SINK,)
        if bad := [x for x in (*inputs, *outputs) if x in self.formulas]:
            raise ValueError(f"not data columns: {bad}")
        name = _unused(name or (build if isinstance(build, str) else build.__name__), [*self.formulas, *self.data_nodes])
        if "filters" in facts:
            facts["filters"] = tuple(facts["filters"])
        made = Formula(name, build, inputs, outputs, **facts)
        if not self.negative_weights and any(w < 0 for w in (made.weight, *made.input_weights.values(), *made.output_weights.values())):
            raise ValueError(f"contradictory paths: {name!r} has a negative weight")
        for x in (*inputs, *outputs):
            if x not in (START, SINK):
                self.data_nodes.setdefault(x, Data(x))
        self.formulas[name] = made
        return name

    def adds(self, outputs, **facts) -> Callable:
        """Decorator form of ``formula``."""
        def add(build):
            self.formula(build, outputs=outputs, **facts)
            return build

        return add

    def add_all(self, data: Iterable[dict] = (), formulas: Iterable[dict] = (), models: Iterable[dict] = ()) -> list[str]:
        """Many declarations at once; the names they got."""
        return [*(self.data(**x) for x in data), *(self.formula(**x) for x in formulas), *(self.model(**x) for x in models)]

    def set_default(self, name: str, value: object, distance: float = 0.0) -> None:
        """Set a data column's default value, or take it away with None."""
        if name not in self.data_nodes:
            raise ValueError(f"{name!r} is not a data column")
        self.data(name, default=value, distance=distance)

    def model(self, child: FormulaGraph, inputs: dict, outputs: dict, name: str | None = None, domain: Callable[[dict[str, Column]], Column] | None = None,
              include_defaults: bool = False) -> str:
        """Nest ``child``: its columns and formulas come in as ``name/column``.

        ``inputs`` maps columns of this graph to columns of the child, ``outputs`` the child's to this graph's (a name
        or several). A way into or out of the child has no length, except that its value first reaches its own
        columns. ``domain`` gets the inputs' columns by this graph's names (NULL where absent); where it isn't true
        the child gets nothing. With ``include_defaults`` a default of the first target of an input comes along
        to this graph, and the others' are dropped; without it the child's defaults stay its own.
        """
        name = _unused(name or child.name or "model", [*self.formulas, *self.data_nodes])
        inside = lambda x: x if x in (START, SINK) else f"{name}/{x}"
        targets = {t for many in inputs.values() for t in _names(many)}
        for d in child.data_nodes.values():
            kept = replace(d, name=inside(d.name))
            if include_defaults and d.name in targets:
                kept = replace(kept, default=None)
            self.data_nodes[kept.name] = kept
        for f in child.formulas.values():
            self.formulas[inside(f.name)] = replace(
                f, name=inside(f.name), inputs=tuple(map(inside, f.inputs)), outputs=tuple(map(inside, f.outputs)),
                input_weights={inside(k): w for k, w in f.input_weights.items()}, output_weights={inside(k): w for k, w in f.output_weights.items()})
        for model, (guard, offered) in child.guards.items():
            self.guards[inside(model)] = (lambda v, guard=guard: guard({k.removeprefix(f"{name}/"): c for k, c in v.items()}), tuple(map(inside, offered)))
        for source, many in inputs.items():
            self.data_nodes.setdefault(source, Data(source))
            for i, target in enumerate(_names(many)):
                default = child.data_nodes[target].default if target in child.data_nodes else None
                if include_defaults and i == 0 and default is not None:
                    self.set_default(source, default, child.data_nodes[target].distance)
                self._link(name, source, inside(target))
        if domain is not None:
            self.guards[name] = (domain, tuple(inputs))
        for source, many in outputs.items():
            for target in _names(many):
                if target not in (START, SINK):
                    self.data_nodes.setdefault(target, Data(target))
                self._link(name, inside(source), target, out=True)
        return name

    def _link(self, model: str, source: str, target: str, out: bool = False) -> None:
        self.data_nodes.setdefault(source, Data(source))
        self.data_nodes.setdefault(target, Data(target))
        name = f"{model}>{target}" if out else f"{model}<{target}"
        self.formulas[name] = Formula(name, lambda x: x, (source,), (target,), input_weights={source: 0.0}, output_weights={target: 0.0})

    def extend(self, *others: FormulaGraph) -> FormulaGraph:
        """The union of the models; of columns declared twice the later declaration holds, formulas get new names."""
        out = self.copy()
        for other in others:
            for d in other.data_nodes.values():
                if d != Data(d.name) or d.name not in out.data_nodes:
                    out.data_nodes[d.name] = d
            for f in other.formulas.values():
                if out.formulas.get(f.name) != f:
                    name = _unused(f.name, out.formulas)
                    out.formulas[name] = replace(f, name=name)
            out.guards |= other.guards
        return out

    def compute(self, df: DataFrame, outputs: str | Iterable[str] | None = None, **how) -> DataFrame:
        """Estimate all data columns, or those that ``outputs`` need, in each row of ``df`` (see ``compile.compute``)."""
        from .compile import compute

        return compute(self, df, _names(outputs) or None, **how)

    def function(self, inputs: Iterable[str], outputs: str | Iterable[str], kinds: dict[str, str] | None = None, as_: str = "struct") -> Callable[..., Column]:
        """The model as a function of Columns: ``f(*inputs)`` gives its outputs as a struct, an array or, of one, the value.

        Arguments may be given by name; too many, unknown, repeated or missing ones (but for those with a default) are a
        ``TypeError``, outputs that can't be reached a ``ValueError``.
        """
        from .compile import as_column

        inputs, outputs = tuple(inputs), _names(outputs)

        def f(*args: Column, **named: Column) -> Column:
            if len(args) > len(inputs):
                raise TypeError(f"{len(inputs)} arguments at most, not {len(args)}")
            given = dict(zip(inputs, args))
            if wrong := [k for k in named if k not in inputs or k in given]:
                raise TypeError(f"unknown or repeated arguments: {wrong}")
            given |= named
            if missing := [x for x in inputs if x not in given and (x not in self.data_nodes or self.data_nodes[x].default is None)]:
                raise TypeError(f"missing arguments: {missing}")
            found = as_column(self, given, outputs, kinds=kinds)
            if as_ == "struct":
                return found
            return found[outputs[0]] if as_ == "value" else F.transform(F.array(found), lambda s: F.array(*[s[x] for x in outputs]))[0]

        return f

    def plan(self, given: Iterable[str], distances: dict[str, float] | None = None) -> list[tuple[float, str, str]]:
        """``(distance, column, formula)`` in the order of visits if all domains hold and nothing fails; no data needed.

        Weights may be negative: where a later visit comes nearer, what it leads to is settled anew. Ways that get shorter
        without end are a ``ValueError``.
        """
        distances, settled, called = distances or {}, {}, set()
        given = dict.fromkeys(given)
        offers = [(distances.get(x, 0.0), x, START) for x in given if x in self.data_nodes]
        offers += [(d.distance + distances.get(x, 0.0), x, START) for x, d in self.data_nodes.items() if d.default is not None and x not in given]
        starts = {x: d for d, x, _ in sorted(offers, reverse=True)}
        heapq.heapify(offers)
        visits = []

        def call() -> None:
            for f in self.formulas.values():
                if f.name not in called and all(x in settled for x in f.inputs):
                    called.add(f.name)
                    at = max(((settled[x], x) for x in f.inputs), default=None)
                    d = at[0] + f.input_length(at[1]) if at else f.weight
                    for x in f.outputs:
                        if x in self.data_nodes and x not in settled:
                            heapq.heappush(offers, (d + f.output_length(self.data_nodes[x]), x, f.name))

        call()
        while offers:
            d, x, f = heapq.heappop(offers)
            if x not in settled:
                settled[x] = d
                visits.append((d, x, f))
                call()
        return corrected(self, starts, visits) if any(length < 0 for *_, length in self.edges()) else visits

    def find(self, text: str) -> str:
        """The column or formula of that name, else the first by name that contains the text."""
        names = [*self.data_nodes, *self.formulas]
        return text if text in names else next(iter(sorted(n for n in names if text in n)))

    def describe(self, name: str) -> str:
        """A column's or formula's description; without one, that of a formula next to it that has one."""
        node = self.data_nodes.get(name) or self.formulas[name]
        near = [f for f in self.formulas.values() if name in f.inputs] + [f for f in self.formulas.values() if name in f.outputs]
        return node.description or next((f.description for f in near if f.description), "")

    def edges(self) -> list[tuple[str, str, float]]:
        """``(source, target, length)`` of all edges, defaults from ``START``."""
        out = [(START, d.name, float(d.distance)) for d in self.data_nodes.values() if d.default is not None]
        for f in self.formulas.values():
            out += [(x, f.name, float(f.input_length(x))) for x in f.inputs or (START,)]
            out += [(f.name, x, float(f.output_length(self.data_nodes.get(x, Data(x))))) for x in f.outputs]
        return out

    def node_rows(self) -> list[tuple]:
        return [(d.name, "data", float(d.weight), d.merge is not None, d.description) for d in self.data_nodes.values()] + [
            (f.name, "formula", float(f.weight), True, f.description) for f in self.formulas.values()]


def corrected(graph: FormulaGraph, starts: dict[str, float], visits: list[tuple[float, str, str]]) -> list[tuple[float, str, str]]:
    """Visits by their shortest ways where lengths may be negative: relaxed until nothing changes, as often as there are columns."""
    best = {x: (d, f) for d, x, f in visits}
    for _ in range(len(best) + 1):
        new = {x: (d, START) for x, d in starts.items()}
        for f in sorted(graph.formulas.values(), key=lambda f: f.name):
            if all(x in best for x in f.inputs):
                at = max(((best[x][0], x) for x in f.inputs), default=None)
                d = at[0] + f.input_length(at[1]) if at else f.weight
                for x in f.outputs:
                    if x in best and (x not in new or d + f.output_length(graph.data_nodes[x]) < new[x][0]):
                        new[x] = (d + f.output_length(graph.data_nodes[x]), f.name)
        if new == best:
            return sorted((d, x, f) for x, (d, f) in best.items())
        best = new
    raise ValueError("contradictory paths: a way round gets shorter each time")
