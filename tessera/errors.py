"""Named errors of the engine; messages carry a hint where there is one."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that the engine raises itself."""


def _named(*names: str) -> list[type[EngineError]]:
    return [type(n, (EngineError,), {"__module__": __name__}) for n in names]


(
    InvalidSyntax, UnsupportedFeature, TableNotFound, TableAlreadyExists, ColumnNotFound, AmbiguousColumn, TypeMismatch,
    IndexAlreadyExists, IndexNotFound, InvalidSubquery, SubqueryReturnedMultipleRows, MixedAggregateAndRegular,
    ColumnNotInGroupBy, CannotUseStarWithGroupBy, AggregateInWhere, HavingWithoutGroupBy, ValidationFailed,
    TooManyEmbeddings, NoActiveTransaction, SerializationFailure, DuplicateExternalId, NodeNotFound,
    SourceNodeNotFound, DestinationNodeNotFound, EdgeNotFound,
) = _named(
    "InvalidSyntax", "UnsupportedFeature", "TableNotFound", "TableAlreadyExists", "ColumnNotFound", "AmbiguousColumn", "TypeMismatch",
    "IndexAlreadyExists", "IndexNotFound", "InvalidSubquery", "SubqueryReturnedMultipleRows", "MixedAggregateAndRegular",
    "ColumnNotInGroupBy", "CannotUseStarWithGroupBy", "AggregateInWhere", "HavingWithoutGroupBy", "ValidationFailed",
    "TooManyEmbeddings", "NoActiveTransaction", "SerializationFailure", "DuplicateExternalId", "NodeNotFound",
    "SourceNodeNotFound", "DestinationNodeNotFound", "EdgeNotFound",
)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def did_you_mean(name: str, known: list[str]) -> str:
    """A hint when a known name is at most two edits away."""
    near = sorted((_distance(name, k), k) for k in known if abs(len(k) - len(name)) <= 2 and len(k) < 64)
    return f" (did you mean '{near[0][1]}'?)" if near and near[0][0] <= 2 else ""
