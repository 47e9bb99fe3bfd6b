"""HTML and text of small result tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

#: Rows of a table that a page shows; the whole table is in its file.
SHOWN = 500


def _cell(v) -> str:
    return html.escape("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))


def page(title: str, tables: dict[str, DataFrame], shown: int = SHOWN) -> str:
    """One page with a section for each table, columns as they stand."""
    parts = []
    for name, df in tables.items():
        rows = df.limit(shown + 1).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows[:shown])
        more = "<p>More rows are in the file of this table.</p>" if len(rows) > shown else ""
        parts.append(f'<section id="{html.escape(name, quote=True)}"><h2>{html.escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}</section>')
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:right}"
    nav = " ".join(f'<a href="#{html.escape(n, quote=True)}">{html.escape(n)}</a>' for n in tables)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><nav>{nav}</nav>{"".join(parts)}</body></html>'


def comparison_line(r) -> str:
    """One test of `paired.compare` in words."""
    p = "p < 0.001" if r.p_value_corrected < 0.001 else f"p = {r.p_value_corrected:.3f}"
    verdict = f"{r.better} is better" if r.significant and r.better else "no significant difference"
    if r.test == "delong":
        return f"{r.name_a} and {r.name_b}: AUROC {r.auroc_a:.3f} and {r.auroc_b:.3f}, difference {r.auroc_diff:+.3f}, {p}; {verdict}"
    return f"{r.name_a} and {r.name_b}: right alone on {r.discordant_b} and {r.discordant_c} of {r.n_total}, {p}; {verdict}"


def ablation_line(r) -> str:
    """One row of `transfer.ablation_tests` in words."""
    p = "" if r.p_holm is None else f", corrected p {r.p_holm:.3f}" + (" *" if r.significant else "")
    return f"without {r.name}: {r.metric} {r.baseline:.4f} to {r.ablated:.4f} ({r.delta_pct:+.1f}% lost{p})"


def text(title: str, tables: dict[str, DataFrame], shown: int = SHOWN) -> str:
    out = [title, "=" * len(title)]
    for name, df in tables.items():
        out += ["", name, "-" * len(name), "\t".join(df.columns)]
        out += ["\t".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df.limit(shown).collect()]
    return "\n".join(out) + "\n"
