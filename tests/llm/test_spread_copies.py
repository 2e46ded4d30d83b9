"""What line dedup spares are copies, not pages that are mostly boilerplate."""

from logsift.llm import line_spread
from tests.llm.conftest import documents


def test_only_proven_copies_keep_spread_lines(spark):
    notice = "a long notice that stands on the pages of every site there is"
    pages = [(i, f"own {i}\n{notice}\n\n", "en", f"s{i}") for i in range(12)]
    whole = [(100 + i, f"a whole document\n{' ' * (i % 3)}that is copied", "en", f"t{i}") for i in range(10)]
    twins = [(200 + i, f"the same text twice\n{notice}", "en", f"u{i}") for i in range(2)]
    bare = [(300, f"{notice}\n{notice}", "en", "v"), (301, None, "en", "v"), (302, "", None, "v")]
    docs = documents(spark, [*pages, *whole, *whole[:1], *twins, *bare])
    rows = line_spread.cleaned(docs).collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(rows) == docs.count()
    assert all(got[i] == f"own {i}\n\n" for i in range(12))
    assert all(got[d] == text for d, text, *_ in whole)
    assert got[200] == got[201] == "the same text twice"
    assert (got[300], got[301], got[302]) == ("", None, "")
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
