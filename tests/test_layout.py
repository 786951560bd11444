import pytest

from tieout import schemas
from tieout.operators import layout

EDGES = [300.0, 360.0, 420.0, 480.0]


class Page:
    """Words of a printed page, row by row."""

    def __init__(self, quarters=4, doc="d", page=1):
        self.words, self.doc, self.page = [], doc, page
        if quarters:
            for k in range(quarters):
                self.word(f"Q{k % 4 + 1}", EDGES[k] - 40, EDGES[k] - 25, 100)
                self.word("2024", EDGES[k] - 22, EDGES[k], 100)

    def word(self, text, x0, x1, top):
        self.words.append((self.doc, self.page, len(self.words), text, float(x0), float(x1), float(top), 800.0))
        return self

    def text(self, text, top, x0=44.6):
        for k, w in enumerate(text.split()):
            self.word(w, x0 + 20 * k, x0 + 20 * k + 15, top)
        return self

    def values(self, top, *values, shift=0):
        for edge, v in zip(EDGES, values):
            if v is not None:
                self.word(v, edge - 30, edge - 1 + shift, top)
        return self


def extract(spark, *pages, strict=True):
    words = spark.createDataFrame([w for p in pages for w in p.words], schemas.WORDS)
    return layout.extract(words, "ISSUER", strict).orderBy("doc_id", "page", "row_ord").collect()


def test_titles_footer_and_values(spark):
    p = Page().text("ISSUER INC", 20).text("Consolidated Balance Sheets", 40).text("(in thousands)", 60)
    p.text("Cash(1)", 120).values(120, "$", "(2)", "3", "4").text("9", 790)
    p.word("1", 281, 299, 121)
    (row,) = extract(spark, p)
    assert row["section_title"] == "Consolidated Balance Sheets | (in thousands)"
    assert row["raw_label"] == "Cash"
    assert row["values"] == {"Q1 2024": 1.0, "Q2 2024": -2.0, "Q3 2024": 3.0, "Q4 2024": 4.0}
    assert row["row_ord"] == 1 and row["section_path"] == []


def test_missing_cells_go_to_the_nearest_edge_and_nil_stays_null(spark):
    p = Page().text("Notes", 120).values(120, None, "5", None, "—")
    p.text("Some", 150).values(150, "1", None, None, "(8)", shift=3)
    a, b = extract(spark, p)
    assert a["values"] == {"Q1 2024": None, "Q2 2024": 5.0, "Q3 2024": None, "Q4 2024": None}
    assert b["values"] == {"Q1 2024": 1.0, "Q2 2024": None, "Q3 2024": None, "Q4 2024": -8.0}


def test_first_value_that_is_not_nil_wins_a_column(spark):
    p = Page().text("Cash", 120)
    for x1, v in ((290, "—"), (299, "7"), (305, "9")):
        p.word(v, x1 - 8, x1, 120)
    assert extract(spark, p)[0]["values"]["Q1 2024"] == 7.0


def test_centred_values_of_a_wrapped_label(spark):
    p = Page().text("Current portion of", 116).values(120, "1", "2", "3", "4").text("convertible notes, net", 125)
    (row,) = extract(spark, p)
    assert row["raw_label"] == "Current portion of convertible notes, net"


def test_prefix_heading_stack_and_rule_lines(spark):
    p = Page().text("Assets:", 110, x0=38.6).text("Current assets:", 125, x0=41).text("Cash", 140).values(140, "1", "2", "3", "4")
    p.text("Long name that", 155).text("Goes on", 170).values(170, "1", "2", "3", "4")
    p.text("____", 185).text("Liabilities", 200, x0=38.6).text("Debt", 215).values(215, "1", "2", "3", "4")
    rows = extract(spark, p)
    assert [r["raw_label"] for r in rows] == ["Cash", "Long name that Goes on", "Debt"]
    assert [r["section_path"] for r in rows] == [["Assets", "Current assets"], ["Assets", "Current assets"], ["Liabilities"]]


def test_years_in_labels_are_label_text(spark):
    p = Page().text("Gross proceeds of 2030 notes", 120).values(120, "1", "2", "3", "4")
    assert extract(spark, p)[0]["raw_label"] == "Gross proceeds of 2030 notes"


def test_page_without_heading_gives_nothing_and_trailing_prefix_is_told(spark):
    words = spark.createDataFrame(Page(quarters=0).text("Dear holders", 120).words + Page(page=2).text("Cash", 120).values(120, "1", "2", "3", "4").text("Lost label", 150).words, schemas.WORDS)
    assert [r["page"] for r in layout.extract(words).collect()] == [2]
    assert [r["label"] for r in layout.trailing_prefixes(layout.roles(layout.labelled(layout.lines(words, "X"), True))).collect()] == ["Lost label"]
    assert layout.document_periods(words).first()["periods"] == ["Q1 2024", "Q2 2024", "Q3 2024", "Q4 2024"]


def test_values_without_label_are_an_error(spark):
    p = Page().text("Cash", 120).values(120, "1", "2", "3", "4").values(150, "5", "6", "7", "8")
    with pytest.raises(Exception, match="carried values but no label"):
        extract(spark, p)
    assert len(extract(spark, p, strict=False)) == 1


def test_unsorted_words_cluster_in_order_of_appearance(spark):
    tops = [100, 104, 108, 96, 112, 99]
    words = spark.createDataFrame([("d", 1, i, "w", 1.0, 2.0, float(t), 800.0) for i, t in enumerate(tops)], schemas.WORDS)
    got = {r["word_seq"]: r["bucket"] for r in layout.cluster(words).collect()}
    assert got == {0: 100, 1: 100, 2: 108, 3: 100, 4: 108, 5: 100}
