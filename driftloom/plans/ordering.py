"""The order of migration steps: dependencies between operations, foreign keys between tables."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from heapq import heappop, heappush

#: Kinds of operations, in the order in which ties are broken.
KINDS = ("drop_fk", "drop_index", "drop_column", "drop_table", "create_table", "add_column", "modify_column", "add_index", "add_fk", "modify_pk")


@dataclass(frozen=True)
class Operation:
    kind: str
    table: str
    name: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}:{self.table}:{self.name}"

    @property
    def rank(self) -> tuple:
        return KINDS.index(self.kind), self.table, self.name


@dataclass
class Graph:
    operations: dict[str, Operation] = field(default_factory=dict)
    after: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))

    def add(self, op: Operation) -> None:
        self.operations[op.id] = op

    def depends(self, later: str, earlier: str) -> None:
        if later != earlier and later in self.operations and earlier in self.operations:
            self.after[earlier].add(later)


def dependency_graph(operations: list[Operation], references: dict[str, set[str]] | None = None) -> Graph:
    """Within a table foreign keys go before indexes, columns and the table, and come back last; across tables the referenced one is created first and dropped last."""
    graph = Graph()
    for op in operations:
        graph.add(op)
    by_table = defaultdict(list)
    for op in operations:
        by_table[op.table].append(op)
    for own in by_table.values():
        for a in own:
            for b in own:
                if KINDS.index(a.kind) < KINDS.index(b.kind):
                    graph.depends(b.id, a.id)
    for table, targets in (references or {}).items():
        for target in targets:
            graph.depends(f"create_table:{table}:", f"create_table:{target}:")
            graph.depends(f"drop_table:{target}:", f"drop_table:{table}:")
            for op in by_table[table]:
                if op.kind == "add_fk":
                    graph.depends(op.id, f"create_table:{target}:")
                if op.kind == "drop_fk":
                    graph.depends(f"drop_table:{target}:", op.id)
    return graph


def topological_order(graph: Graph) -> tuple[list[Operation], list[str]]:
    """(all operations in order, ids on or behind cycles); those come last, by rank."""
    waiting = {x: 0 for x in graph.operations}
    for later in graph.after.values():
        for x in later:
            waiting[x] += 1
    heap: list = []
    for x, n in waiting.items():
        if not n:
            heappush(heap, (graph.operations[x].rank, x))
    done = []
    while heap:
        _, x = heappop(heap)
        done.append(graph.operations[x])
        for y in graph.after[x]:
            waiting[y] -= 1
            if not waiting[y]:
                heappush(heap, (graph.operations[y].rank, y))
    left = sorted((op for x, op in graph.operations.items() if waiting[x]), key=lambda op: op.rank)
    return done + left, [op.id for op in left]


def created_in_order(tables: list[str], references: dict[str, set[str]]) -> list[str]:
    """Tables so that referenced ones come first; members of a cycle by name."""
    graph = dependency_graph([Operation("create_table", t) for t in tables], {t: references.get(t, set()) for t in tables})
    return [op.table for op in topological_order(graph)[0]]


def dropped_in_order(tables: list[str], references: dict[str, set[str]]) -> list[str]:
    """Tables so that referencing ones come first; members of a cycle by name."""
    graph = dependency_graph([Operation("drop_table", t) for t in tables], {t: references.get(t, set()) for t in tables})
    return [op.table for op in topological_order(graph)[0]]
