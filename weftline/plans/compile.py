"""From a formula graph to one DataFrame plan in which every row takes its own shortest path.

Each data column becomes three plain columns: its distance (NULL: it can't be had in that row), the formula it came
from and its value. Off cycles it is chosen once, among the estimations of its formulas, by distance and then by name.
Columns on a cycle are settled in rounds, nearest first, so a formula never sees a value that a shorter path would
replace. What is computed in one step is a layer: a projection of its own. Formulas are guarded by CASE, so a row
where one fails takes the next path within the same projection.

The steps don't know what a layer is: ``compute`` makes projections of them, ``as_column`` a chain of structs, so that a
graph can also be one Column, as in an ordered fold.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import SINK, START, Data, Formula, FormulaGraph


def _reads(graph: FormulaGraph, f: Formula) -> tuple[str, ...]:
    """What a formula reads: its inputs and, on the way into a nested model, what the model's domain gets."""
    return (*f.inputs, *(x for model, (_, offered) in graph.guards.items() if f.name.startswith(f"{model}<") for x in offered))


def needed(graph: FormulaGraph, outputs: tuple[str, ...], given: set[str]) -> FormulaGraph:
    """The part of the graph from which the outputs can be reached, without what lies behind given columns."""
    out, todo, seen = FormulaGraph(graph.name), list(outputs), set()
    out.guards = dict(graph.guards)
    while todo:
        x = todo.pop()
        if x in seen or x not in graph.data_nodes:
            continue
        seen.add(x)
        out.data_nodes[x] = graph.data_nodes[x]
        if x in given:
            continue
        for f in graph.formulas.values():
            if x in f.outputs:
                out.formulas[f.name] = f
                todo += _reads(graph, f)
    for f in out.formulas.values():
        for x in f.outputs:
            if x in graph.data_nodes:
                out.data_nodes.setdefault(x, graph.data_nodes[x])
    return out


def _groups(graph: FormulaGraph) -> list[list[str]]:
    """Data columns in an order in which each comes after what it needs; those on common cycles in one group."""
    feeds = {x: sorted({i for f in graph.formulas.values() if x in f.outputs for i in _reads(graph, f) if i in graph.data_nodes}) for x in graph.data_nodes}
    number, low, path, out = {}, {}, [], []
    for root in sorted(feeds):
        work = [(root, iter(feeds[root]))] if root not in number else []
        while work:
            x, rest = work[-1]
            if x not in number:
                number[x] = low[x] = len(number)
                path.append(x)
            for y in rest:
                if y not in number:
                    work.append((y, iter(feeds[y])))
                    break
                if y in path:
                    low[x] = min(low[x], number[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == number[x]:
                    out.append(path[path.index(x):])
                    del path[path.index(x):]
    return out


def _built(build, values: list[Column], names: list[str] | None):
    """A formula's Columns: from its builder, or from SQL text with ``$1``, ``$2``, ... for its inputs."""
    if callable(build):
        return build(*values)
    if isinstance(build, (list, tuple)):
        return tuple(_built(b, values, names) for b in build)
    at = names or [f"x.v{i}" for i in range(len(values))]
    for i in range(len(values), 0, -1):
        build = build.replace(f"${i}", at[i - 1])
    if names is not None:
        return F.expr(build)
    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.call_function("transform", F.array(row), F.expr(f"x -> {build}"))[0]


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _least(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.least(*parts)


def _first(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out if otherwise is None else out.otherwise(otherwise)


class _Scope:
    """How the layers' columns are read at the moment: as columns of a table, or as fields of the row of a lambda."""

    def __init__(self, read: Callable[[str], Column], prefix: str = "__n"):
        self.read, self.prefix, self.many = read, prefix, 0


class _Layer:
    """A layer's columns by key. Each use reads a column anew, as the scope has it by then."""

    def __init__(self, keys: Iterable[str], scope: _Scope):
        self.scope, self.names = scope, {k: f"{scope.prefix}{scope.many + i}" for i, k in enumerate(keys)}
        scope.many += len(self.names)

    def __contains__(self, key: str) -> bool:
        return key in self.names

    def __getitem__(self, key: str) -> Column:
        return self.scope.read(self.names[key])


class _State:
    """What is known of a data column at some step: ``d`` (NULL: not had), ``f``, ``v``."""

    def __init__(self, layer: _Layer, x: str, formula: str | None = None):
        self.layer, self.x, self.formula = layer, x, formula

    def __getattr__(self, part: str) -> Column:
        if part not in "dfv":
            raise AttributeError(part)
        return F.lit(self.formula) if part == "f" and self.formula else self.layer[f"{self.x}|{part}"]

    @property
    def label(self) -> str:
        return self.layer.names[f"{self.x}|v"]


class _Call:
    """A formula's call at some step: ``a``, its distance or NULL; ``ready``: all inputs were had; ``v``: results by place."""

    def __init__(self, first: _Layer, second: _Layer, formula: Formula):
        self.first, self.second, self.formula = first, second, formula

    @property
    def a(self) -> Column:
        return self.first[f"{self.formula.name}|a"]

    @property
    def ready(self) -> Column:
        return self.first[f"{self.formula.name}|r"]

    @property
    def v(self) -> dict[int, Column]:
        return {i: self.second[k] for i in range(len(self.formula.outputs)) if (k := f"{self.formula.name}|v{i}") in self.second}


def _calls(graph: FormulaGraph, names: list[str], at: dict[str, _State], before: dict[str, _Call], raises: str, named: bool):
    """Layers that call formulas, those that some row can call.

    ``before`` has the results of an earlier round, which hold in the rows where all inputs were settled then.
    """
    first, second, open_ = {}, {}, []
    for f in (graph.formulas[n] for n in names):
        if any(x not in at for x in f.inputs):
            continue
        inputs = [at[x] for x in f.inputs]
        ready = _all([s.d.isNotNull() for s in inputs])
        values, labels = [s.v for s in inputs], [s.label for s in inputs] if named else None
        for model, (domain, offered) in graph.guards.items():
            if f.name.startswith(f"{model}<"):
                ready = ready & F.coalesce(domain({n: F.when(at[n].d.isNotNull(), at[n].v) if n in at else F.lit(None) for n in offered}), F.lit(False))
        if f.domain is not None:
            ready = F.when(ready, F.coalesce(_built(f.domain, values, labels), F.lit(False))).otherwise(False) if f.inputs else F.coalesce(_built(f.domain, values, labels), F.lit(False))
        # The input that arrives last decides the distance; of several the last one by name.
        lengths = {x: float(f.input_length(x)) for x in f.inputs}
        last = F.greatest(*[s.d for s in inputs]) if len(inputs) > 1 else inputs[0].d if inputs else F.lit(float(f.weight))
        if len(set(lengths.values())) > 1:
            last = _first([(at[x].d == last, last + lengths[x]) for x in sorted(f.inputs, reverse=True)])
        elif lengths:
            last = last + next(iter(lengths.values()))
        old = before.get(f.name)
        first[f"{f.name}|a"] = _first([*([(old.ready, old.a)] if old else []), (ready, last)])
        first[f"{f.name}|r"] = _all([s.d.isNotNull() for s in inputs])
        open_.append((f, inputs, labels, old))
    got = yield first
    for f, inputs, labels, old in open_:
        built = _built(f.build, [s.v for s in inputs], labels)
        built = built if isinstance(built, tuple) else (built,)
        for g in f.filters:
            built = tuple(map(g, built))
        if raises == "error":  # at least one output must be there
            built = (F.coalesce(built[0], *(F.when(b.isNotNull(), F.lit(None)) for b in built[1:]), F.when(_all([b.isNull() for b in built]), F.raise_error(F.lit(f"formula {f.name} failed")))), *built[1:])
        for i, (x, v) in enumerate(zip(f.outputs, built)):
            if x in graph.data_nodes or raises == "record":
                second[f"{f.name}|v{i}"] = _first([*([(old.ready, old.v[i])] if old and i in old.v else []), (got[f"{f.name}|a"].isNotNull(), v)])
    values = yield second
    return {f.name: _Call(got, values, f) for f, *_ in open_}


def _offers(graph: FormulaGraph, node: Data, made: dict[str, _Call], start: _State | None) -> list[tuple]:
    """``(formula, distance or NULL, value)`` of a column's estimations, by name."""
    out = []
    for name in sorted(made):
        f = graph.formulas[name]
        for i, x in enumerate(f.outputs):
            if x == node.name:
                v, at = made[name].v[i], made[name].a
                d = at + float(f.output_length(node))
                counts = v.isNotNull() & at.isNotNull()
                if start is not None and node.merge is None:  # it counts if it was there before the given value, or leads here no later
                    counts = counts & (start.d.isNull() | (at < start.d) | (d <= start.d))
                out.append((name, F.when(counts, d), v.cast(node.dtype) if node.dtype else v))
    return out


def _choices(graph: FormulaGraph, nodes: list[Data], made: dict[str, _Call], starts: dict[str, _State]):
    """Layers that choose among each column's estimations and its given value."""
    def offered() -> dict[str, list[tuple]]:
        return {n.name: _offers(graph, n, {f: r for f, r in made.items() if n.name in graph.formulas[f].outputs}, starts.get(n.name)) for n in nodes}

    offers = offered()
    plain = [n for n in nodes if n.merge is None and offers[n.name]]
    best = yield {f"{n.name}|b": _least([d for _, d, _ in offers[n.name]]) for n in plain}
    offers, chosen = offered(), {}
    for n in nodes:
        start, some = starts.get(n.name), offers[n.name]
        if n.merge is not None:
            absent = {f for f, x in graph.formulas.items() if n.name in x.outputs} - {o[0] for o in some}
            if absent:
                continue
            parts = {f: v for f, _, v in some} | ({START: start.v} if start is not None else {})
            distances = [d for _, d, _ in some] + ([start.d] if start is not None else [])
            ready = _all([x.isNotNull() for x in distances])
            d = F.greatest(F.lit(0.0), *distances)
            chosen[n.name] = (F.when(ready, d), F.lit("merge"), n.merge(parts))
        elif some:
            b = best[f"{n.name}|b"]
            cases = [(d == b, f, v) for f, d, v in some] if len(some) > 1 else [(b.isNotNull(), some[0][0], some[0][2])]
            f = _first([(test, F.lit(name)) for test, name, _ in cases], F.lit(START) if start is not None else None)
            v = _first([(test, v) for test, _, v in cases], start.v if start is not None else None)
            chosen[n.name] = (F.when(b.isNotNull(), F.least(b, start.d)).otherwise(start.d) if start is not None else b, f, v)
        elif start is not None:
            chosen[n.name] = (start.d, start.f, start.v)
    for n in nodes:
        if n.name in chosen and n.filters:
            d, f, v = chosen[n.name]
            for g in n.filters:
                v = g(v)
            chosen[n.name] = (F.when(d.isNotNull() & v.isNotNull(), d), f, v)
    got = yield {f"{x}|{k}": c for x, parts in chosen.items() for k, c in zip("dfv", parts)}
    return {x: _State(got, x) for x in chosen}


def _potentials(graph: FormulaGraph, group: list[str], inner: list[str]) -> dict[str, float]:
    """Numbers to take off the distances of a cycle's columns so that each step leads no nearer; none if all lengths are 0 or more.

    A way round that is shorter than nothing has no shortest path: a ``ValueError``.
    """
    steps = [(u, v, f.input_length(u) + f.output_length(graph.data_nodes[v])) for f in map(graph.formulas.get, inner) for u in f.inputs for v in f.outputs if u in group and v in group]
    if all(length >= 0 for *_, length in steps):
        return {}
    low = dict.fromkeys(group, 0.0)
    for _ in group:
        for u, v, length in steps:
            low[v] = min(low[v], low[u] + length)
    if any(low[u] + length < low[v] for u, v, length in steps):
        raise ValueError(f"contradictory paths: a way round {sorted(group)} gets shorter each time")
    return low


def _settled(graph: FormulaGraph, starts: dict[str, _State], raises: str, named: bool):
    """All layers of a graph; returns the state of each data column and the calls of each formula."""
    at: dict[str, _State] = {}
    results: dict[str, _Call] = {}
    for group in _groups(graph):
        inner = sorted(f for f, x in graph.formulas.items() if set(x.outputs) & set(group))
        nodes = [graph.data_nodes[x] for x in group]
        cyclic = len(group) > 1 or any(set(graph.formulas[f].inputs) & set(group) for f in inner)
        if not cyclic:
            fresh = [f for f in inner if f not in results]
            results |= (yield from _calls(graph, fresh, at, {}, raises, named)) if fresh else {}
            at |= yield from _choices(graph, nodes, {f: results[f] for f in inner if f in results}, starts)
            continue
        state: dict[str, _State] = {}
        low = _potentials(graph, group, inner)
        height = lambda x, d: d - F.lit(low[x]) if low else d
        for turn in range(len(group) + bool(low)):  # with negative lengths the last round only looks for contradictions
            # After the first round only formulas that read the group can have news.
            open_ = [f for f in inner if f not in results or set(graph.formulas[f].inputs) & set(group)]
            results |= yield from _calls(graph, open_, at | state, {f: results[f] for f in open_ if f in results}, raises, named)
            chosen = yield from _choices(graph, nodes, {f: results[f] for f in inner if f in results}, starts)
            # The nearest columns that aren't settled yet are settled in this round.
            waiting = [F.when(state[x].d.isNull(), height(x, c.d)) if x in state else height(x, c.d) for x, c in chosen.items()]
            # A lambda ends the generated method here: all rounds in one would be too large for the JVM to compile.
            near = F.transform(F.array(_least(waiting)), lambda d: d)[0] if waiting else None
            nearest = yield {f"{group[0]}|near": near} if waiting else {}
            near = nearest[f"{group[0]}|near"] if waiting else None
            step = {}
            for x, c in chosen.items():
                was = state.get(x)
                for k in "dfv":
                    kept = [(was.d.isNotNull(), getattr(was, k))] if was else []
                    if was and low and k == "d":
                        kept.insert(0, (c.d < was.d, F.raise_error(F.lit(f"contradictory paths: {x} is nearer than it was taken for")).cast("double")))
                    step[f"{x}|{k}"] = _first([*kept, (height(x, c.d) == near, getattr(c, k))])
            got = yield step
            state = {x: _State(got, x) for x in chosen}
        at |= state
    return at, results


def _starts(graph: FormulaGraph, given: dict[str, Column], distances: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    """Distance and value of each column that is given or has a default."""
    out = {}
    for x, node in graph.data_nodes.items():
        known = [given[x]] if x in given else []
        d = F.lit(float(distances.get(x, 0.0)))
        if node.default is not None:
            default = node.default if isinstance(node.default, Column) else F.lit(node.default)
            own = F.lit(float(node.distance + distances.get(x, 0.0)))
            d = F.when(given[x].isNotNull(), d).otherwise(own) if known else own
            known.append(default)
        if known:
            v = F.coalesce(*known) if len(known) > 1 else known[0]
            v = v.cast(node.dtype) if node.dtype else v
            out[x] = (F.when(v.isNotNull(), d), v)
    return out


def _steps(graph: FormulaGraph, given: dict[str, Column], distances: dict[str, float], raises: str, named: bool):
    """The layers of given values and all that follows from them."""
    made = _starts(graph, given, distances)
    got = yield {f"{x}|{k}": c for x, (d, v) in made.items() for k, c in (("d", d), ("v", v))}
    starts = {x: _State(got, x, START) for x in made}
    return (yield from _settled(graph, starts, raises, named))


@contextlib.contextmanager
def lenient(spark: SparkSession, on: bool = True):
    """Expressions that are built within give NULL where they fail; they keep that when they run."""
    name, old = "spark.sql.ansi.enabled", spark.conf.get("spark.sql.ansi.enabled")
    if on:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


#: Formulas up to which filters on the results of a graph without cycles may be moved below it.
_OPEN_FORMULAS = 3


def _prefix(df: DataFrame) -> str:
    """How the layers' columns are called, so that none is called like one of the table's."""
    out = "__n"
    while any(c.startswith(out) for c in df.columns):
        out = f"_{out}"
    return out


def _layered(df: DataFrame, steps) -> tuple[DataFrame, object]:
    """Each layer as a projection of ``df``; columns that nothing needs any more are pruned by Catalyst."""
    scope, send = _Scope(F.col, _prefix(df)), None
    while True:
        try:
            layer = steps.send(send)
        except StopIteration as end:
            return df, end.value
        send = _Layer(layer, scope)
        if layer:
            df = df.select("*", *[c.alias(send.names[k]) for k, c in layer.items()])


def _last_uses(steps, outputs: tuple[str, ...]) -> dict[str, float]:
    """The last layer (from 0; those without columns don't count) that reads each column; for what outputs are read from, infinity."""
    uses: dict[str, float] = {}
    n, send = 0, None

    def read(name: str) -> Column:
        uses[name] = n
        return F.col(name)

    scope = _Scope(read)
    while True:
        try:
            layer = steps.send(send)
        except StopIteration as end:
            at = end.value[0]
            return uses | {at[x].layer.names[f"{x}|{part}"]: float("inf") for x in outputs if x in at for part in "dv"}
        send, n = _Layer(layer, scope), n + bool(layer)


def as_column(graph: FormulaGraph, given: dict[str, Column], outputs: Iterable[str], distances: dict[str, float] | None = None,
              kinds: dict[str, str] | None = None) -> Column:
    """The graph as one Column, a struct of the ``outputs`` (NULL where they can't be had), for use in lambdas and aggregates.

    Layers are a chain: each is a ``transform`` of an array of one struct, the columns of the layers before that are still
    read. No lambda holds another's, so a graph may have any number of layers. Spark's analyzer resolves a chain link by link;
    for long ones its limit of iterations is raised in the session. Spark interprets lambdas, so ``compute`` is faster
    where rows are columns of a table.
    """
    outputs = tuple(outputs)
    graph = needed(graph, outputs, set())
    begin = lambda: _steps(graph, {x: c for x, c in given.items() if x in graph.data_nodes}, distances or {}, "null", named=False)
    steps, uses = begin(), _last_uses(begin(), outputs)
    scope, chain, live, send, n, done = _Scope(F.col), None, [], None, 0, False

    def body(row: Column | None) -> Column:
        nonlocal live, send, n, done
        scope.read = lambda name: row[name]
        try:
            layer = {}
            while not layer:
                layer = steps.send(send)
                send = _Layer(layer, scope)
        except StopIteration as end:
            done, at = True, end.value[0]
            if missing := [x for x in outputs if x not in at]:
                raise ValueError(f"outputs that can't be reached: {missing}") from None
            found = {x: F.when(at[x].d.isNotNull(), at[x].v) for x in outputs}
            return F.struct(*[(c.cast(kinds[x]) if kinds else c).alias(x) for x, c in found.items()])
        kept = [f for f in live if uses.get(f, -1) > n]
        live, n = kept + list(send.names.values()), n + 1
        return F.struct(*[row[f].alias(f) for f in kept], *[layer[k].alias(name) for k, name in send.names.items()])

    while not done:
        chain = F.array(body(None)) if chain is None else F.transform(chain, lambda row: body(row))
    _make_room(_ITERATIONS * n)
    return chain[0]


#: Iterations of the analyzer that a link of a chain takes at most.
_ITERATIONS = 5


def _make_room(iterations: int) -> None:
    spark, name = SparkSession.active(), "spark.sql.analyzer.maxIterations"
    if iterations > int(spark.conf.get(name)):
        spark.conf.set(name, str(iterations))


def compute(graph: FormulaGraph, df: DataFrame, outputs: tuple[str, ...] | None = None, distances: dict[str, float] | None = None,
            wildcard: bool | int = False, lineage: bool = False, cutoff: bool = True, nested: bool = False,
            complete: tuple[str, ...] = (), raises: str = "null") -> DataFrame:
    """``df`` with a column for each data column of the graph (in each row: as far as it can be had there, else NULL).

    Columns of ``df`` that the graph doesn't know stay as they are; a NULL in one that it knows means that it isn't
    given in that row. ``distances`` are added to the distances at which given columns and defaults start.
    ``outputs`` leaves out what isn't needed for them; with ``cutoff`` what lies beyond the farthest of them is NULL
    then. It is an error if no row could have one of them. With ``wildcard`` a column that is given and asked for feeds the
    formulas, but its result is computed anew; with ``wildcard=2`` one that no formula estimates stays as given.
    ``nested`` shows columns of nested models, too. ``complete`` names columns that every row gives, so that formulas for
    them are left out; columns that can't be NULL are known to be. ``lineage`` adds ``workflow``: the columns had, nearest
    first, with distance and formula.

    A formula fails where all its results are NULL; divisions, casts and overflows that raise in ANSI mode give NULL, too.
    With ``raises="null"`` the row then takes the next path, with ``"record"`` it does so and a column ``errors`` names
    the formulas that failed, with ``"error"`` the query ends with the first failure.
    """
    if raises not in ("null", "record", "error"):
        raise ValueError(f"unknown policy {raises!r}")
    distances = distances or {}
    given = [c for c in df.columns if c in graph.data_nodes]
    wild = tuple(x for x in outputs or () if wildcard and x in given and graph.data_nodes[x].wildcard and (wildcard != 2 or any(x in f.outputs for f in graph.formulas.values())))
    if wild:
        graph, df = _wild(graph, df, wild)
        given = [c for c in df.columns if c in graph.data_nodes]
        distances = {f"{x}*" if x in wild else x: d for x, d in distances.items()}
    if outputs is not None:
        graph = needed(graph, outputs, {c for c in given if c in complete or (not df.schema[c].nullable and c not in outputs)})
    with lenient(df.sparkSession, raises != "error"):
        wide, (at, calls) = _layered(df, _steps(graph, {x: df[x] for x in given if x in graph.data_nodes}, distances, raises, named=True))
        if missing := [x for x in outputs or () if x not in at and x not in wild]:
            raise ValueError(f"outputs that can't be reached: {missing}")
        return _selected(graph, wide, df, at, calls, outputs, wild, lineage, cutoff, nested, raises)


def _wild(graph: FormulaGraph, df: DataFrame, wild: tuple[str, ...]) -> tuple[FormulaGraph, DataFrame]:
    out = graph.copy()
    for x in wild:
        out.data_nodes[f"{x}*"] = replace(graph.data_nodes[x], name=f"{x}*", merge=None)
        out.data_nodes[x] = replace(graph.data_nodes[x], default=None)
    swap = lambda x: f"{x}*" if x in wild else x
    out.formulas = {n: replace(f, inputs=tuple(map(swap, f.inputs)), input_weights={swap(k): w for k, w in f.input_weights.items()}) for n, f in graph.formulas.items()}
    return out, df.withColumnsRenamed({x: f"{x}*" for x in wild})


def _selected(graph: FormulaGraph, wide: DataFrame, df: DataFrame, at: dict[str, _State], calls: dict[str, dict], outputs, wild, lineage: bool, cutoff: bool, nested: bool, raises: str) -> DataFrame:
    shown = {x: s for x, s in at.items() if x != SINK and not (x.endswith("*") and x[:-1] in wild) and (nested or "/" not in x)}
    seen = {x: s.d for x, s in shown.items()}
    if outputs is not None and cutoff and outputs and all(x in shown for x in outputs):
        # Rows that have all outputs stop at the farthest of them, and at ties after it by name.
        every = _all([shown[x].d.isNotNull() for x in outputs])
        far = F.greatest(*[shown[x].d for x in outputs]) if len(outputs) > 1 else shown[outputs[0]].d
        at_most, at_last = f"{_prefix(df)}far", f"{_prefix(df)}last"
        wide = wide.select("*", F.when(every, far).alias(at_most))
        last = _first([(shown[x].d == F.col(at_most), F.lit(x)) for x in sorted(outputs, reverse=True)])
        wide = wide.select("*", last.alias(at_last))
        seen = {x: F.when(F.col(at_most).isNull() | (d < F.col(at_most)) | ((d == F.col(at_most)) & (F.lit(x) <= F.col(at_last))), d) for x, d in seen.items()}
    other = [wide[c] for c in df.columns if c not in graph.data_nodes and not (c.endswith("*") and c[:-1] in wild)]
    columns = {x: F.when(seen[x].isNotNull(), s.v) for x, s in shown.items()}
    if lineage:
        steps = F.array(*[F.when(seen[x].isNotNull(), F.struct(s.d.alias("distance"), F.lit(x).alias("node"), s.f.alias("formula"))) for x, s in shown.items()])
        columns["workflow"] = F.array_sort(F.array_compact(steps))
    if raises == "record":
        failed = [F.when(c.a.isNotNull() & _all([v.isNull() for v in c.v.values()]), F.lit(f)) for f, c in sorted(calls.items())]
        columns["errors"] = F.array_compact(F.array(*failed)) if failed else F.expr("cast(array() as array<string>)")
    cyclic = any(len(g) > 1 or any(g[0] in f.inputs and g[0] in f.outputs for f in graph.formulas.values()) for g in _groups(graph))
    if cyclic or len(graph.formulas) > _OPEN_FORMULAS:
        # Catalyst would move filters on results below the layers and infer constraints through them, and write out each
        # formula again for each use. A condition that always holds stops it; filter given columns before ``compute``.
        columns = {x: F.when(F.rand(0) + 1 > 0, c) for x, c in columns.items()}
    return wide.select(*other, *[c.alias(x) for x, c in columns.items()])
