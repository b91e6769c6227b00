"""Bounded previews: one job of at most n rows, rendered as text and as HTML from the same rows."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class Preview:
    columns: list[tuple[str, T.DataType]]
    rows: list[tuple]

    def text(self) -> str:
        cells = [[n for n, _ in self.columns]] + [["" if v is None else str(v) for v in r] for r in self.rows]
        if not self.columns:
            return "++\n++"
        widths = [max(len(r[i]) for r in cells) for i in range(len(self.columns))]
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        line = lambda r: "|" + "|".join(f" {v.ljust(w)} " for v, w in zip(r, widths, strict=True)) + "|"
        return "\n".join([rule, line(cells[0]), rule, *map(line, cells[1:]), rule])

    def html(self) -> str:
        count = f"{len(self.rows)} rows, {len(self.columns)} columns"
        if not self.columns:
            return f"<p>No columns; {count}</p>"
        kind = ["number" if isinstance(t, T.NumericType) else "text" for _, t in self.columns]
        head = "".join(f'<th class="{k}">{html.escape(n)}<br><small>{html.escape(t.simpleString())}</small></th>' for (n, t), k in zip(self.columns, kind, strict=True))
        cell = lambda v, k: f'<td class="{k}">' + ("<i>null</i>" if v is None else html.escape(str(v))) + "</td>"
        body = "".join("<tr>" + "".join(cell(v, k) for v, k in zip(r, kind, strict=True)) + "</tr>" for r in self.rows)
        return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table><p>{count}</p>"

    _repr_html_ = html
    __str__ = text


def preview(df: DataFrame, n: int = 20) -> Preview:
    rows = df.limit(n).collect()
    return Preview([(f.name, f.dataType) for f in df.schema], [tuple(r) for r in rows])
