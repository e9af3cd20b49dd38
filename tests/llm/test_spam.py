import time

import pytest

from svlattice.llm import spam

REAL = "The report was sent to the night shift after 4 days. We keep the first record of each cluster, and both ends lie in introns."
SPAM = [
    "cheap sequencing cheap sequencing bam to vcf cheap sequencing bam to vcf",
    "cheap sequencing Ashford | cheap sequencing Oxford | cheap sequencing Fencote | cheap sequencing Larkham",
    "Home | Shop | Cart | Login | Sitemap | Kits | Offers",
    "#buydnakit #svcaller #exomediscount #bamtovcf",
    "http://a-1.example/p/1 //b.test/x www.c.shop.example/y",
    "Sv Caller REF-1234 EUR 12.50\nBam To Vcf SKU-9911 $ 99.00",
    '<a href="//x.test/y">sv caller</a> <a href="//z.test/">bam to vcf</a>',
    "Bam to vcf bam to vcf! Sv caller bam to vcf. Bam to vcf sv caller sv caller?",
    "buy-dna-kit-buy-dna-kit-sv-caller-buy-dna-kit",
    "and cheap sequencing the cheap sequencing for cheap sequencing to cheap sequencing",
    "染色体报告 染色体报告 测序优惠 染色体报告 测序优惠 测序优惠",
]


@pytest.mark.parametrize("text", SPAM)
def test_spam_alone_and_beside_a_sentence(text):
    assert spam.is_spam(text)
    long = "\n".join([text] * 9)
    assert spam.is_spam(f"{REAL}\n{long}") and spam.is_spam(f"{long}\n\n{REAL}")
    assert not spam.is_spam("\n".join([REAL] * 20 + [text]))


@pytest.mark.parametrize(
    "text",
    [
        REAL, "", "   \n", None, "品質値は73.9でした。", "2031-01-02 10:11:12 INFO merge: done, with 4 left\n" * 5,
        "Type: DEL\nGene: BG28\nReads: 9", "chr1\t5\tx\tN\t<DEL>\t9\tPASS\n" * 6, ">seq\n" + "ACGT" * 80,
        f"{REAL}\n\nReferences\n[1] //a.test/x\n[2] https://b.example/y/z\n[3] www.c.test/d",
        f"{REAL}\n\nKeywords: clean, split read, size bin, inversion", "Dear all,\n\nthe run is done.\n\nBest,\nA",
    ],
)
def test_not_spam(text):
    assert not spam.is_spam(text)


@pytest.mark.parametrize(
    "text",
    [
        "Twinkle twinkle little star\nHow I wonder what you are\nUp above the world so high\nLike a diamond in the sky", "Roses are red,\nViolets are blue,\nSugar is sweet,\nAnd so are you.",
        "1. Introduction\n2. Methods\n3. Results\n4. Discussion\n5. References", "Introduction ........ 1\nMethods ........ 4\nResults ....... 9\nDiscussion ........ 12\nReferences ........ 15",
        "hey can you look at the run from yesterday and tell me what you think of it", "We saw <s> in the text, and it is a control token of no meaning here.",
    ],
)
def test_verses_contents_and_plain_lines(text):
    assert not spam.is_spam(text)


def test_keywords_without_repeats():
    assert spam.is_spam("buy viagra online cheap pills discount pharmacy order now best price free shipping overnight")
    assert spam.is_spam("cheap sequencing\ngene test\nread aligner\nbam viewer\nvcf converter\nexome offer\ntumour panel")


def test_few_shapes_decide():
    """Many small shapes of non-sentences don't make a page spam, few large ones do."""
    kinds = ["d | e | f", "#a #b #c", "http://a.test/b", "<p>word</p>", "X USD 1.00", "one one one one one one"]
    shapes = spam.page_shapes("\n".join(kinds))
    assert len({s[1] for s in shapes}) == len(kinds) and all(s[0] == spam.OTHER for s in shapes)
    assert spam.is_spam("\n".join(kinds)) and not spam.is_spam("\n".join(kinds), few=2)


@pytest.mark.parametrize("unit", ["a-", "a.", "A-", "//", "#", "a/", "'a", "[1] ", "EUR ", "AB-12 ", "<a ", '"', ". )", "x"])
def test_time_is_linear(unit):
    """A megabyte of one unit, with and without a text before it."""
    began = time.process_time()
    spam.is_spam("see a.b " + unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 5


def test_table(spark):
    df = spark.createDataFrame([(1, SPAM[0]), (2, REAL), (3, None), (4, ""), (1, SPAM[0])], "doc_id long, text string")
    assert [r.doc_id for r in spam.spam_pages(df, "doc_id", "text").collect()] == [1, 1]
    assert spam.spam_pages(df.limit(0), "doc_id", "text").count() == 0
    assert not spam.is_spam("word " * 3 + "x" * 200_000)
