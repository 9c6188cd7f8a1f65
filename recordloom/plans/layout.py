"""Output column layouts: small lists of {id, title, order, selected} that decide a projection."""

from __future__ import annotations


def normalize(layout: list[dict]) -> list[dict]:
    """Orders of the selected columns as 1, 2, ...; the others 0."""
    chosen = sorted((c for c in layout if c["selected"]), key=lambda c: c["order"])
    at = {c["id"]: i for i, c in enumerate(chosen, 1)}
    return [c | {"order": at.get(c["id"], 0)} for c in layout]


def move_to(layout: list[dict], column: str, position: int) -> list[dict]:
    """Swap a column with the holder of a position; positions out of range change nothing."""
    layout = normalize(layout)
    held = {c["order"]: c["id"] for c in layout if c["selected"]}
    own = next((o for o, i in held.items() if i == column), None)
    if own is None or not 1 <= position <= len(held):
        return layout
    swap = {column: position, held[position]: own}
    return [c | {"order": swap.get(c["id"], c["order"])} for c in layout]


def nudge(layout: list[dict], column: str, by: int) -> list[dict]:
    own = next((c["order"] for c in normalize(layout) if c["id"] == column), 0)
    return move_to(layout, column, own + by)


def insert_at(layout: list[dict], column: str, position: int) -> list[dict]:
    """Take a column out and put it in at a position; those after it move on."""
    chosen = [c["id"] for c in sorted((c for c in layout if c["selected"] and c["id"] != column), key=lambda c: c["order"])]
    chosen.insert(max(0, min(position - 1, len(chosen))), column)
    at = {i: n for n, i in enumerate(chosen, 1)}
    return [c | {"order": at.get(c["id"], 0), "selected": c["id"] in at} for c in layout]


def toggle(layout: list[dict], column: str) -> list[dict]:
    """A column that is taken in comes last; one that is left out closes the gap."""
    last = max((c["order"] for c in layout if c["selected"]), default=0)
    return normalize([c | {"selected": not c["selected"], "order": last + 1} if c["id"] == column else c for c in layout])


def reset(layout: list[dict], default: list[dict]) -> list[dict]:
    """The default, followed by the layout's own extra columns."""
    extras = [c for c in layout if c["id"].startswith("extra_")]
    return normalize([*default, *({**c, "order": len(default) + i} for i, c in enumerate(extras, 1))])


def add_extra(layout: list[dict], title: str) -> list[dict]:
    used = {c["id"] for c in layout}
    n = next(n for n in range(1, len(layout) + 2) if f"extra_{n}" not in used)
    return [*layout, {"id": f"extra_{n}", "title": title, "order": max((c["order"] for c in layout), default=0) + 1, "selected": True}]


def rename_extra(layout: list[dict], column: str, title: str) -> list[dict]:
    """The title of an extra column changed; other columns keep theirs."""
    return [c | {"title": title} if c["id"] == column and column.startswith("extra_") else c for c in layout]


def remove_extra(layout: list[dict], column: str) -> list[dict]:
    """An extra column taken out, the gap closed; other columns stay."""
    return normalize([c for c in layout if c["id"] != column or not column.startswith("extra_")])


#: The titles of the ten-column export.
EXPORT = normalize([{"id": i, "title": t, "order": n, "selected": True} for n, (i, t) in enumerate((
    ("stt1", "Stt 1"), ("stt2", "Stt 2"), ("code", "Mã TT 43, 21"), ("code_1", "Mã TT 23 (PL1)"), ("code_2", "Mã TT 23 (PL2)"),
    ("name", "Tên Danh mục kỹ thuật theo Thông tư 32/2023/TT-BYT"), ("name_1", "Tên DMKT theo Phụ lục 1 Thông tư 23/2024/TT-BYT"), ("name_2", "Tên DMKT theo Phụ lục 2 Thông tư 23/2024/TT-BYT"),
    ("procedure", "QTKT tương ứng tại Bệnh viện"), ("units", "Số Đơn vị thực hiện"),
), 1)])
