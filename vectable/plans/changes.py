"""What changes between two declarations of a table, decided on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from vectable.spec import SpecError, TableSpec


@dataclass(frozen=True)
class SpecChange:
    added: tuple[str, ...]
    removed: tuple[str, ...]
    changed: tuple[str, ...]

    @property
    def in_place(self) -> bool:
        """Only new columns: no row has to be rewritten."""
        return not self.removed and not self.changed


_LIMITS = ("data_type", "dim", "max_length", "max_capacity", "element_type", "nullable",
           "is_primary_key", "is_partition_key", "is_clustering_key", "is_auto_id")


def spec_change(old: TableSpec, new: TableSpec) -> SpecChange:
    before, after = old.by_name, new.by_name
    shared = [n for n in after if n in before]
    changed = [n for n in shared
               if any(getattr(before[n], a) != getattr(after[n], a) for a in _LIMITS)]
    return SpecChange(
        tuple(n for n in after if n not in before),
        tuple(n for n in before if n not in after),
        tuple(changed),
    )


def require_addable(old: TableSpec, new: TableSpec) -> tuple[str, ...]:
    """Names that may be added without a rewrite; raises when the change needs one."""
    change = spec_change(old, new)
    refused = [n for n in change.added if not new.by_name[n].nullable or new.by_name[n].is_vector]
    if refused:
        raise SpecError(f"only nullable scalar fields can be added: {', '.join(refused)}")
    if not change.in_place:
        raise SpecError(f"needs a rewrite: {', '.join(change.removed + change.changed)}")
    return change.added
