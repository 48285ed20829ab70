"""What only looks like a secret stays; what belongs together is found over a whole paragraph."""

import random
import string

import pytest

pytest.importorskip("facetflow.llm")

from facetflow.llm import secrets  # noqa: E402

CLEAN = [
    "Docs at https://docs.example.com/guide explain AbstractServerFactoryV2BeanProvider",
    "username: alice posted DSC20240101PhotoAlbumNr5x",
    "user: bob wrote InternationalizationUtils2024Handler and https://www.example.org/a/b?c=d",
    "login: eve sees https://example.com/watch/Ab3dEfGh1jKlMn0pQrSt",
    "See https://example.com/Foo2BarBazQuuxQuuzCorge and http://example.org",
    "account_id: 12 IMG_20231224_183000_Weihnachten2",
]


@pytest.mark.parametrize("text", CLEAN)
def test_ordinary_text_stays(text):
    assert secrets.redacted(text) == text


def test_a_named_word_masks_no_address():
    text = "token: refresh is described at https://example.com/help"
    assert secrets.redacted(text) == "[secret] is described at https://example.com/help"


@pytest.mark.parametrize("apart", [10, 241, 5000])
def test_parts_meet_over_the_whole_paragraph(apart):
    value = "q7Zk2VbX9mLt4RwY8sPd"
    text = f"client_id: web-app-17 {'word ' * (apart // 5)}{value}"
    assert sorted(k for k, _, _ in secrets.linked_spans(text, secrets.base_spans(text))) == ["link_id", "link_secret"]
    assert value not in secrets.redacted(text)
    assert value in secrets.redacted(text.replace(" word", "\n\nword", 1))


def test_services_are_endpoints():
    value = "q7Zk2VbX9mLt4RwY8sPd"
    for place in ("https://api.example.com:8443/v1", "https://bob@git.example.com/x", "postgres://db.example.com/main", "host: db.example.net", "endpoint = https://s.example.net"):
        text = f"{place} {value}"
        assert sorted(k for k, _, _ in secrets.linked_spans(text, secrets.base_spans(text))) == ["link_endpoint", "link_secret"], place
    assert secrets.redacted(f"https://www.example.com/page {value}") == f"https://www.example.com/page {value}"


def test_most_random_values_look_random():
    rng = random.Random(8)
    letters = string.ascii_letters + string.digits
    values = ["".join(rng.choice(letters) for _ in range(rng.choice([20, 32, 40]))) for _ in range(2000)]
    assert sum(map(secrets.looks_random, values)) >= 0.95 * len(values)


def test_documents_have_no_false_spans(spark):
    """No linked span in ordinary texts and pages, where the tables hold single secrets only."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id AS doc_id", "html AS text")
    for df in (docs, pages):
        assert secrets.scan(df).where("n_linked > 0").count() == 0
