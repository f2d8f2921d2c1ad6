"""The U1 mapInPandas hook runs a vectorised extractor over whole texts."""

import pandas as pd

from runlens.operators.atoms import extract_line_atoms, extract_with
from runlens.sources.tables import read_table
from tests.conftest import SMOKE


def test_hook_matches_builtin(spark):
    # nested, so it is shipped by value to the Python workers
    def _lines(batches):
        for pdf in batches:
            parts = pdf.assign(line=pdf["text"].str.split("\n")).explode("line")
            parts["line_no"] = parts.groupby(level=0).cumcount() + 1
            parts = parts[parts["line"].str.strip(" ") != ""]
            n = parts["line"].str.len()
            kind = pd.Series("long", index=parts.index)
            kind[n < 200] = "medium"
            kind[n < 40] = "short"
            yield pd.DataFrame({"doc_id": parts["doc_id"].values, "line_no": parts["line_no"].values,
                                "atom_type": kind.values, "n_chars": n.values})

    docs = read_table(spark, SMOKE, "documents").select("doc_id", "text")
    hook = extract_with(docs, _lines, "doc_id long, line_no long, atom_type string, n_chars long")
    built = extract_line_atoms(docs)
    a = sorted(map(tuple, hook.collect()))
    b = sorted((r.doc_id, r.line_no, r.atom_type, r.n_chars) for r in built.collect())
    assert a == b
