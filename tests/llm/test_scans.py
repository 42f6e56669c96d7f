from marlstone.llm import scans

TEXT = """Methods

It remains unclear whether the measured layers of the northern slope are larger
than the coupled layers. The other group of the first years was drawn from the
archive, and most of the figures were coun-
ted twice in every replicate of the trial before the end of the whole campaign.
{extra}
The former years of the archive are larger than those of the coupled layers."""


def kinds(text, section="Methods"):
    lines, k = scans.judge(text, section)
    return {x: line for line, x in zip(lines, k) if x in ("header", "pageno")}


def test_page_numbers_and_headers():
    for line in ("12", "- 12 -", "– 3 –", "[7]", "p. 43", "Page 3 of 215", "xiv", "S. 9"):
        assert kinds(TEXT.format(extra=line)) == {"pageno": line}
    for line in ("THE BRIWIX PAPERS", "4   THE BRIWIX PAPERS", "CHAPTER 12. SEASONAL TARIFFS   9", "Annals of Briwix Studies 42 (1991)", "KRUWEN AND $USITH"):
        assert kinds(TEXT.format(extra=line)) == {"header": line}
    for line in ("9).", "[9].", "of the first trial", "Zoth, 1999).", "1328."):
        assert kinds(TEXT.format(extra=line)) == {}


def test_headings_are_no_headers():
    assert kinds("Error Analysis\n\nSome text is here and goes on.\nAnd one more line of it.", "Error Analysis") == {}
    assert kinds("Err0r Analysis\n\nSome text is here and goes on.\nAnd one more line of it.", "Error Analysis") == {}


def rows(spark, texts):
    return spark.createDataFrame([(i, "d", "Methods", t, "c") for i, t in texts], "chunk_id bigint, doc string, section string, text string, words string")


def corpus():
    filler = [(100 + i, "The measured layers were counted twice under the follow-up trial. The young markets were counted and measured.") for i in range(60)]
    return filler


def test_traces(spark):
    texts = [
        *corpus(),
        (1, TEXT.format(extra="p. 4")),
        (2, "The rneasured layers."),
        (3, "The mea5ured layers of mark@ts."),
        (4, "Strozi8en is a name."),
        (5, "It was a follow-\nup of the trial."),
        (6, None), (7, ""), (8, "H2SO4 and CO2 in 1999, at 5th and 34kPa."), (2, "The rneasured layers."),
    ]
    got = {(r.chunk_id, r.kind) for r in scans.scan_traces(rows(spark, texts)).collect()}
    assert got == {(1, "hyphen"), (1, "pageno"), (2, "misread"), (3, "misread"), (4, "misread")}


def test_repair(spark):
    texts = [*corpus(), (1, TEXT.format(extra="THE BRIWIX PAPERS   7")), (3, "The mea5ured layers of the young m@rkets were coun¬\nted. Mea5ured again."), (5, "It was a follow-\nup of the trial."), (6, None)]
    got = {r.chunk_id: r.repaired for r in scans.repair(rows(spark, texts)).collect()}
    assert got[1].startswith("Methods\n\nIt remains unclear") and "BRIWIX" not in got[1] and "figures were counted twice" in got[1] and got[1].count("\n") == 2
    assert got[3] == "The measured layers of the young markets were counted. Measured again."
    assert got[5] == "It was a follow-up of the trial." and got[6] is None


def test_empty(spark):
    assert scans.scan_traces(rows(spark, [])).count() == 0


def test_confusions_are_learned_from_the_collection(spark):
    common = ["measured", "layers", "counted", "twice", "follow", "markets", "northern"]
    # `#` for e is in no table; the inflections at the end are as frequent among frequent words
    rare = [w.replace("e", "#", 1) for w in common if "e" in w] + ["markete", "layere"]
    vocabulary = spark.createDataFrame([(w, 4000) for w in common] + [("measures", 300), ("markete", 90), ("layere", 80)] + [(w, 1) for w in rare if "#" in w], "word string, n bigint")
    pairs, learned = scans.confusions(vocabulary)
    got = {(r.misread, r.printed): r.support for r in learned.collect()}
    assert got == {("#", "e"): 6} or got == {("#", "e"): sum("#" in w for w in rare)}
    fixes = {r.word: r.correction for r in scans.corrections(pairs, learned).collect()}
    assert fixes == {w: w.replace("#", "e") for w in rare if "#" in w}
    names = spark.createDataFrame([("oluk#ar", 1), ("oluk%ar", 1)], "word string, n bigint")
    assert {r.word for r in scans.misread_names(names, learned).collect()} == {"oluk#ar"}


def test_headers_repeat_on_pages(spark):
    body = "the measured layers were counted again and again\nuntil the archive was closed in the evening"
    texts = [(n, "d", n, "of the brittle markets" + "\n\n" + body) for n in (1, 2, 3)] + [(4, "e", 1, "of the brittle markets\n\n" + body), (5, None, 1, "of the brittle markets\n\n" + body)]
    df = spark.createDataFrame([(i, d, p, "(preamble)", t) for i, d, p, t in texts], "chunk_id bigint, doc string, page int, section string, text string")
    assert {(r.chunk_id, r.kind) for r in scans.scan_traces(df).collect()} == {(1, "header"), (2, "header"), (3, "header")}
    got = {r.chunk_id: r.repaired for r in scans.repair(df).collect()}
    assert "brittle" not in got[1] and "brittle" in got[4]


def test_lists_are_repaired_line_by_line(spark):
    items = "1. The mea5ured layers\n2. of the young mark-\nets and more\n3. The follow-\nup trial\n4. last one"
    df = rows(spark, [*corpus(), (1, items), (2, "x\n12\ny\n13\nz")])
    got = {r.chunk_id: r.repaired for r in scans.repair(df).collect()}
    assert got[1] == "1. The measured layers\n2. of the young markets\n and more\n3. The follow-up\n trial\n4. last one"
