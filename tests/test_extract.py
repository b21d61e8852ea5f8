from pyspark.sql import functions as F

from quire.functions.links import canonical_url
from quire.functions.text import clean_inline, first_heading, leading_int, snippet, trimmed
from quire.operators import extract
from quire.sources.corpus import route_books, route_files

FILE = "path string, rel_path string, mtime timestamp, size bigint, content string"


def talk(frame, text):
    row = extract.parse_talk_header(frame([(text,)], "content string")).first()
    return row.title, row.speaker, row.content


def test_modern_header_with_audio_line_and_repeated_title(frame):
    text = "# Hope\n\n🎧 [Listen to Audio](https://m/x.mp3)\n\n# Hope\n\nBy Elder A. Person\n\nOf a Quorum\n\nBody.\n"
    assert talk(frame, text) == ("Hope", "Elder A. Person", "\nOf a Quorum\n\nBody.\n")


def test_header_variants(frame):
    assert talk(frame, "# T\n\n[Listen to Audio](x)\n\nBy President P\n\nB")[1] == "President P"
    assert talk(frame, "# T\n\nElder Plain\n\nOf the Twelve\n")[1] == "Elder Plain"
    assert talk(frame, "# T\n\nby elder so-and-so\n\nB")[1] == "elder so-and-so"
    assert talk(frame, "# T\n\nBy *Elder X*\n\nB")[1] == "*Elder X*"
    assert talk(frame, "# T\n\n([D 1:2](../x.md))\n\nBy Elder Y\n\nB")[1] == "Elder Y"
    assert talk(frame, "# T\n\nBy\nB")[1:] == ("By", "B")
    # Unicode white space around lines, and a title that is only a marker
    assert talk(frame, "# \n # T \r\n \r\nBy  Z\r\nB")[:2] == ("T", "Z")


def test_no_speaker_keeps_the_body_after_the_title(frame):
    assert talk(frame, "# T\n\n🎧 x\n") == ("T", "", "\n🎧 x\n")
    # a line that is only markup ends the search without a speaker
    assert talk(frame, "# T\n<sup>1</sup>\nElder\n") == ("T", "", "<sup>1</sup>\nElder\n")


def test_no_title_empties_everything(frame):
    row = extract.parse_talk_header(frame([("Just prose.\n",)], "content string")).first()
    assert (row.title, row.speaker, row.content, row.suspicious) == ("", "", "", True)


def test_suspicious_speaker_counts_bytes(frame):
    rows = frame([("é" * 100,), ("é" * 101,), ("",), ("a Listen to Audio b",), ("Elder",)], "s string")
    got = [r[0] for r in rows.select(extract.suspicious_speaker(F.col("s"))).collect()]
    assert got == [False, True, True, True, False]


def test_canonical_url(frame):
    base = "https://www.churchofjesuschrist.org/study/"
    cases = {
        "/data/gospel-library/eng/scriptures/ot/gen/1.md": base + "scriptures/ot/gen/1?lang=eng",
        "eng/general-conference/2020/04/x.md": base + "general-conference/2020/04/x?lang=eng",
        "/eng/manual/a.md": base + "manual/a?lang=eng",
        "/data/books/b/1.md": "",
        "books/b/1.md": "",
        "": "",
        "eng": "",
        "eng/": "",
        "//x.md": "",
    }
    rows = frame([(k,) for k in cases], "p string").select("p", canonical_url(F.col("p")).alias("u"))
    assert {r.p: r.u for r in rows.collect()} == cases
    assert frame([(None,)], "p string").select(canonical_url(F.col("p"))).first()[0] == ""


def test_clean_inline_and_trim(frame):
    text = 'a<sup>[b](#fn-2)</sup>  [see\tthis](x.md)<sup>c</sup> *d* '
    row = frame([(text, " x y \r\n")], "t string, u string").select(
        clean_inline(F.col("t")), trimmed(F.col("u"))
    ).first()
    assert tuple(row) == ("a see this *d*", "x y")


def test_first_heading_needs_an_untrimmed_marker(frame):
    rows = frame([(" # no\n#no\n#  Yes \n# later",), ("none",), ("# \n# second",)], "c string")
    got = [r[0] for r in rows.select(first_heading(F.col("c"), F.lit("fb"))).collect()]
    assert got == ["Yes", "fb", "fb"]


def test_snippet_cuts_code_points(frame):
    got = frame([("é" * 240,), (" " + "é" * 241,)], "t string").select(snippet(F.col("t"))).collect()
    assert [r[0] for r in got] == ["é" * 240, "é" * 240 + "…"]


def test_leading_int(frame):
    rows = frame([("7a",), ("-2",), (" +3",), ("x",), ("99999999999",)], "t string")
    assert [r[0] for r in rows.select(leading_int(F.col("t"))).collect()] == [7, -2, 3, None, None]


def test_extract_verses(frame):
    text = "# H\n**1.** One\rx<sup>[a](#fn-1)</sup>\n **2.** indented\n**3.**\n**4.**Four  \n**5** no\n**99999999999.** big"
    files = route_files(frame([("eng/scriptures/bofm/1-ne/3.md",) * 2 + (None, 1, text)], FILE))
    got = extract.extract_verses(files).orderBy("verse").collect()
    assert [(r.verse, r.text, r.reference) for r in got] == [
        (1, "One x", "1 Nephi 3:1"), (4, "Four", "1 Nephi 3:4"),
    ]


def test_chunks_skip_blanks_and_go_on_after_2000_code_points(frame):
    text = "a\n\n \n\n<sup>x</sup>\n\n" + "é" * 2001 + "\n\n\nlast"
    got = extract.chunk_paragraphs(
        frame([("talks", 1, text)], "source_type string, source_id bigint, content string")
    ).collect()
    assert [(r.layer, r.content) for r in got] == [
        ("paragraph", "a"), ("paragraph_1", "é" * 2000), ("paragraph_1+1", "é"), ("paragraph_2", "last"),
    ]


def test_routes(frame):
    paths = {
        "eng/scriptures/ot/gen/03.md": ("scriptures", "routed"),
        "eng/scriptures/ot/gen/intro.md": (None, "ignored"),
        "eng/scriptures/ot/gen.md": (None, "ignored"),
        "eng/scriptures/tg/faith.md": ("study_aids", "routed"),
        "eng/scriptures/jst/a/b.md": ("study_aids", "routed"),
        "eng/scriptures/maps/a/1.md": (None, "ignored"),
        "eng/general-conference/2020/04/x.md": ("talks", "routed"),
        "eng/general-conference/late/04/x.md": (None, "ignored"),
        "eng/manual/c/x.md": ("manuals", "routed"),
        "eng/liahona/2020/x.md": (None, "skipped"),
        "eng/x.md": (None, "ignored"),
    }
    rows = route_files(frame([(p, p, None, 1, "") for p in paths], FILE)).collect()
    assert {r.path: (r.content_type, r.outcome) for r in rows} == paths
    by_path = {r.path: r for r in rows}
    assert by_path["eng/scriptures/ot/gen/03.md"].chapter == 3
    assert by_path["eng/scriptures/jst/a/b.md"].slug == "a/b"
    books = route_books(frame([("r/one.md", "one.md", None, 1, ""), ("r/c/d/two.md", "c/d/two.md", None, 1, "")], FILE))
    assert [(r.collection, r.section) for r in books.collect()] == [("one.md", "one"), ("c", "two")]


def test_backfill_statuses(frame):
    talks = frame(
        [(1, "a", "old"), (2, "b", "Elder B"), (3, "c", "x"), (4, "d", "y")],
        "id bigint, file_path string, speaker string",
    )
    files = frame(
        [("a", "a", None, 1, "# T\nBy Elder A\n"), ("b", "b", None, 1, "# T\nElder B\n"), ("c", "c", None, 1, "# T\n")],
        FILE,
    )
    checked = extract.backfill_speakers(talks, files)
    assert {r.id: r.status for r in checked.collect()} == {1: "changed", 2: "unchanged", 3: "failed", 4: "missing"}
    assert [tuple(r) for r in extract.backfill_updates(checked).collect()] == [(1, "a", "Elder A")]
    assert {r.status: r.n for r in extract.backfill_summary(checked).collect()} == {
        "changed": 1, "unchanged": 1, "failed": 1, "missing": 1, "total": 4,
    }
