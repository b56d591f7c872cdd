"""What each search looks at: fields with labels and weights, in the order that decides the snippet."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    label: str
    column: str
    weight: int
    exact: int | None = None

    @property
    def exact_weight(self) -> int:
        return self.weight if self.exact is None else self.exact


@dataclass(frozen=True)
class Search:
    """Fields are scored in any order; `snippets` names the columns in the order in which they may show."""

    fields: tuple[Field, ...]
    snippets: tuple[str, ...] = ()
    previews: tuple[str, ...] = ()

    def only(self, *columns: str) -> Search:
        """The same search over fewer fields."""
        return Search(tuple(f for f in self.fields if f.column in columns))

    def ordered(self, columns: tuple[str, ...]) -> list[Field]:
        by = {f.column: f for f in self.fields}
        return [by[c] for c in columns] if columns else list(self.fields)


DOCUMENTS = Search(
    (
        Field("Title", "title", 400, 900),
        Field("Filename", "original_filename", 300, 700),
        Field("Notes", "notes", 200),
        Field("Extracted text", "extracted_text", 100),
    ),
    previews=("notes", "extracted_text", "original_filename", "title"),
)

SYMPTOMS = Search(
    (
        Field("Title", "title", 400, 900),
        Field("Description", "description", 250),
        Field("System", "system", 120),
        Field("Suspected causes", "suspected_causes", 220),
        Field("Notes", "notes", 140),
    )
)

PROCEDURES = Search(
    (
        Field("Title", "title", 400, 900),
        Field("System", "system", 120),
        Field("Tools needed", "tools_needed", 180),
        Field("Parts needed", "parts_needed", 220),
        Field("Safety notes", "safety_notes", 180),
        Field("Steps", "steps", 240),
        Field("Notes", "notes", 140),
    )
)

NOTES = Search(
    (
        Field("Title", "title", 400, 900),
        Field("Content", "content", 260),
        Field("Note type", "note_type", 100),
        Field("Linked item", "linked_title", 160),
    ),
    snippets=("content", "title", "linked_title", "note_type"),
    previews=("content", "title", "linked_title", "note_type"),
)
