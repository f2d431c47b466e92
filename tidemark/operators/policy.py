"""Access policy: rules and a request give a decision with filters, filters give a predicate for scans.

The predicate goes into a query before anything is ranked, counted or walked, so that what may not be seen has no effect.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ordering import CLASSIFICATION

ROLES = ("reader", "writer", "admin", "owner")
NEEDS = {"read": "reader", "write": "writer", "export": "admin", "admin": "admin"}
AXES = ("collections", "sources", "memory_kinds", "entity_types", "predicates")


def level(name: str | None, ladder: Sequence[str]) -> int:
    return ladder.index(name) + 1 if name in ladder else 0


@dataclass
class Filters:
    max_classification: str | None = None
    denied_classifications: set[str] = field(default_factory=set)
    allowed: dict[str, set[str]] = field(default_factory=dict)
    denied: dict[str, set[str]] = field(default_factory=dict)

    def restrictive(self) -> bool:
        return bool(self.max_classification or self.denied_classifications or any(self.allowed.values()) or any(self.denied.values()))

    def permitted(self) -> list[str]:
        """Classifications up to the ceiling without the carved-out ones."""
        top = level(self.max_classification or CLASSIFICATION[-1], CLASSIFICATION)
        return [c for c in CLASSIFICATION[:top] if c not in self.denied_classifications]

    def condition(self, columns: dict[str, str], axes: Sequence[str] = AXES) -> Column:
        """The predicate over a record's columns, given as axis -> column (``classification`` among them).

        An allow-list keeps records without a collection, and those whose entity type or predicate is empty; it drops those
        without a source. A deny-list keeps records that have no value.
        """
        if not self.restrictive():
            return F.lit(True)
        out = F.col(columns["classification"]).isin(*self.permitted()) if self.permitted() else F.lit(False)
        for axis in axes:
            if axis not in columns:
                continue
            c = F.col(columns[axis])
            if some := sorted(self.allowed.get(axis) or ()):
                inside = F.coalesce(c.isin(*some), F.lit(False))
                out = out & {"collections": c.isNull() | inside, "entity_types": (c == "") | inside, "predicates": (c == "") | inside}.get(axis, inside)
            if some := sorted(self.denied.get(axis) or ()):
                out = out & ~F.coalesce(c.isin(*some), F.lit(False))
        return F.coalesce(out, F.lit(False))


@dataclass
class Rule:
    name: str
    effect: str
    actions: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    principals: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    purposes: tuple[str, ...] = ()
    residencies: tuple[str, ...] = ()
    graph_spaces: tuple[str, ...] = ()
    classifications: tuple[str, ...] = ()
    resources: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_classification: str | None = None
    not_before: datetime | None = None
    not_after: datetime | None = None

    def narrows(self) -> bool:
        """Whether the rule is about some resources only."""
        return bool(self.classifications or any(self.resources.values()))

    def concerns(self, r: "Request", role: str | None) -> bool:
        one = lambda some, x: not some or x in some
        fold = lambda some, x: not some or (x or "").lower() in {s.lower() for s in some}
        return (
            not (self.not_before and r.at < self.not_before)
            and not (self.not_after and r.at >= self.not_after)
            and one(self.principals, r.principal)
            and one(self.kinds, r.kind)
            and one(self.roles, role)
            and fold(self.purposes, r.purpose)
            and fold(self.residencies, r.residency)
            and one(self.graph_spaces, r.graph_space)
            and one(self.actions, r.action)
        )


@dataclass
class Request:
    principal: str
    action: str
    workspace: str
    at: datetime
    grants: dict[str, str] = field(default_factory=dict)
    kind: str = "user"
    system_role: str | None = None
    purpose: str | None = None
    residency: str | None = None
    graph_space: str | None = None


@dataclass
class Decision:
    allowed: bool
    reason: str
    rule: str | None = None
    filters: Filters = field(default_factory=Filters)


def evaluate(rules: Sequence[Rule], request: Request, default_clearance: str = "internal") -> Decision:
    """Denials without a resource win over all; those about resources and allowances become filters; else the role decides."""
    role = request.grants.get(request.workspace)
    if role is None and request.system_role != "owner":
        return Decision(False, "no grant for this workspace")
    filters = Filters(max_classification=default_clearance)
    fits = [r for r in rules if r.concerns(request, role)]
    for r in fits:
        if r.effect == "deny" and not r.narrows():
            denied = [x.name for x in fits if x.effect == "deny" and not x.narrows()][-1]
            return Decision(False, f"denied by rule {denied}", denied)
    raised = 0
    allowing = [r for r in fits if r.effect != "deny"]
    for r in fits:
        target = filters.denied if r.effect == "deny" else filters.allowed
        for axis, some in r.resources.items():
            if some:
                target.setdefault(axis, set()).update(some)
        if r.effect == "deny":
            filters.denied_classifications.update(r.classifications)
        else:
            raised = max(raised, level(r.max_classification, CLASSIFICATION))
    if raised > level(filters.max_classification, CLASSIFICATION):
        filters.max_classification = CLASSIFICATION[raised - 1]
    if allowing:
        return Decision(True, f"allowed by rule {allowing[0].name}", allowing[0].name, filters)
    if max(level(role, ROLES), level(request.system_role, ROLES)) >= level(NEEDS.get(request.action), ROLES) > 0:
        return Decision(True, "allowed by the principal's role", None, filters)
    return Decision(False, f"the principal's role does not permit {request.action}")


def narrowed(filters: Filters, clearance: str | None) -> Filters:
    """A grant's own clearance can lower the ceiling, never raise it."""
    if not clearance:
        return filters
    top = min(level(filters.max_classification or CLASSIFICATION[-1], CLASSIFICATION), level(clearance, CLASSIFICATION))
    return Filters(CLASSIFICATION[max(top, 1) - 1], filters.denied_classifications, filters.allowed, filters.denied)
