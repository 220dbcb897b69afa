from __future__ import annotations

import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.pii import KINDS, Feistel, Pseudonyms, luhn, pseudonymise

from .data import clashing, docs

KEY = b"test"
ALL = frozenset(KINDS)


def replaced(text, key=KEY, back=False):
    counts = dict.fromkeys(KINDS, 0)
    return Pseudonyms(key, back).text(text, counts, ALL), {k: n for k, n in counts.items() if n}


@pytest.mark.parametrize("bound", [2, 3, 10, 97, 1000, 4097])
def test_feistel_is_a_permutation(bound):
    f = Feistel(KEY)
    image = [f.permute(i, bound, "t") for i in range(bound)]
    assert sorted(image) == list(range(bound))
    assert [f.permute(i, bound, "t", back=True) for i in image] == list(range(bound))
    if bound > 50:
        assert image != [f.permute(i, bound, "other") for i in range(bound)]
        assert image != [Feistel(b"other").permute(i, bound, "t") for i in range(bound)]


@given(st.integers(2, 10**30), st.data())
@settings(max_examples=60, deadline=None)
def test_feistel_inverts(bound, data):
    value = data.draw(st.integers(0, bound - 1))
    image = Feistel(KEY).permute(value, bound, "x")
    assert 0 <= image < bound and Feistel(KEY).permute(image, bound, "x", back=True) == value


@pytest.mark.parametrize(
    ("kind", "value", "form"),
    [
        ("card", "4111111111111111", r"4\d{15}"),
        ("card", "4111 1111 1111 1111", r"4\d{3} \d{4} \d{4} \d{4}"),
        ("card", "3782-822463-10005", r"3\d{3}-\d{6}-\d{5}"),
        ("phone", "+1 (743) 555-3824", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        ("phone", "(743) 555-3824", r"\(\d{3}\) \d{3}-\d{4}"),
        ("email", "und.34@mail7.example.com", r"[a-z]{3}\.\d\d@mail7\.example\.com"),
        ("ip", "129.38.82.176", r"\d+\.\d+\.\d+\.\d+"),
        ("ssn", "123-45-6789", r"\d{3}-\d{2}-\d{4}"),
        ("iban", "DE89370400440532013000", r"DE\d{20}"),
        ("iban", "GB82 WEST 1234 5698 7654 32", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d"),
        ("date", "2021-02-28", r"\d{4}-\d\d-\d\d"),
        ("date", "28.02.2021", r"\d\d\.\d\d\.\d{4}"),
        ("date", "02/28/2021", r"\d\d/\d\d/\d{4}"),
    ],
)
def test_kinds_keep_their_form_and_rules(kind, value, form):
    text, counts = replaced(f"before ({value}), after")
    assert counts == {kind: 1}
    new = text.removeprefix("before (").removesuffix("), after")
    assert new != value and re.fullmatch(form, new)
    # The pseudonym is valid itself, so it is found again and the key's holder can undo it.
    assert replaced(text, back=True) == (f"before ({value}), after", {kind: 1})


@pytest.mark.parametrize(
    "text",
    [
        "4111111111111112", "9807915762804491 " * 2, "1.2.3", "300.1.1.1", "01.02.03.04", "2021-02-30", "31/12/2021", "000-12-3456", "666-12-3456",
        "DE89370400440532013001", "a@b", "@home", "12345", "version 1.2.3.4.5", "year 2021", "1234567", "", "3.14159265358979",
    ],
)
def test_what_fails_its_rules_stays(text):
    assert replaced(text) == (text, {})


@pytest.mark.parametrize("zero", ["\u0660", "\u06f0", "\u0966", "\uff10"], ids=["arabic-indic", "persian", "devanagari", "full width"])
@pytest.mark.parametrize(
    ("kind", "value"),
    [
        ("phone", "+49 30 1234 567"), ("phone", "(743) 555-3824"), ("card", "4111 1111 1111 1111"), ("ip", "129.38.82.176"), ("ip", "1.2.3.4"),
        ("ssn", "123-45-6789"), ("date", "2021-02-28"), ("date", "3.12.2021"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("email", "und.34@mail7.example.com"),
    ],
)
def test_digits_of_other_scripts(zero, kind, value):
    script = str.maketrans("0123456789", "".join(chr(ord(zero) + i) for i in range(10)))
    before, after = "\u0967 é ", ", \u0668"
    text, counts = replaced(before + value.translate(script) + after)
    assert counts == {kind: 1}
    # The same pseudonym as in 0-9, in the digits of the text; what is no value keeps its own.
    plain = replaced(value)[0]
    assert plain != value and text == before + plain.translate(script) + after
    assert replaced(text, back=True) == (before + replaced(plain, back=True)[0].translate(script) + after, {kind: 1})


def test_digits_of_several_scripts_in_a_number():
    value = "+49 \u0663\u0660 \u0967234 567"
    text, counts = replaced(value)
    assert counts == {"phone": 1} and replaced(text, back=True)[0] == value


@pytest.mark.parametrize(("value", "bound"), [(1 << 40, 1000), (1000, 1000), (-1, 1000), (1, 1), (5, 0)])
def test_values_out_of_bounds_are_an_error(value, bound):
    with pytest.raises(ValueError, match="not below"):
        Feistel(KEY).permute(value, bound, "t")


def test_equal_values_stay_linked_and_different_ones_apart():
    cards = [f"4{i:014d}" for i in range(300)]
    cards = [c + str(luhn(c)) for c in cards]
    new = [replaced(c)[0] for c in cards]
    assert len(set(new)) == 300 and all(luhn(c[:-1]) == int(c[-1]) for c in new)
    assert replaced(f"{cards[7][:4]} {cards[7][4:8]} {cards[7][8:12]} {cards[7][12:]}")[0].replace(" ", "") == new[7]
    assert replaced(f"{cards[1]} {cards[2]}")[0] == f"{new[1]} {new[2]}"
    assert replaced(cards[7], key=b"other")[0] != new[7]


@given(st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)), st.sampled_from(["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"]))
@settings(max_examples=80, deadline=None)
def test_dates_stay_dates(day, form):
    new, counts = replaced(day.strftime(form))
    assert counts == {"date": 1}
    assert datetime.datetime.strptime(new, form).strftime(form) == new
    assert replaced(new, back=True)[0] == day.strftime(form)


def test_table(spark):
    rows = [
        (1, "call +1 (743) 555-3824 or mail a.b@c.example.org", "en", "s", 1), (2, "call +1 (743) 555-3824", None, None, None), (3, None, None, None, None),
        (4, "", None, None, None), (None, "card 4111111111111111", None, None, None), (5, "clean text, 42 things", None, None, None),
        (6, "x " * 100_000 + "4111111111111111", None, None, None), (2, "call +1 (743) 555-3824", None, None, None),
    ]
    got = pseudonymise(clashing(docs(spark, rows), "id", "n_found"), KEY).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    assert (by[1].n_found, by[2].n_found, by[3].n_found, by[4].n_found, by[5].n_found, by[6].n_found, by[None].n_found) == (2, 1, 0, 0, 0, 1, 1)
    assert by[3].text is None and by[4].text == "" and by[5].text == "clean text, 42 things"
    assert by[2].text.removeprefix("call ") in by[1].text
    assert by[6].text.endswith(by[None].text.removeprefix("card ")) and by[1].found["email"] == 1
    undone = pseudonymise(docs(spark, [(g.doc_id, g.text, None, None, None) for g in got]), KEY, back=True).collect()
    assert sorted(repr((g.doc_id, g.text)) for g in undone) == sorted(repr(r[:2]) for r in rows)


def test_kinds_can_be_chosen(spark):
    row = (1, "+1 (743) 555-3824 und.34@mail7.example.com", None, None, None)
    got = pseudonymise(docs(spark, [row]), KEY, kinds=("email",)).first()
    assert got.text.startswith("+1 (743) 555-3824 ") and got.n_found == 1
    with pytest.raises(ValueError, match="unknown"):
        pseudonymise(docs(spark, [row]), KEY, kinds=("name",))


def test_empty_table(spark):
    assert pseudonymise(docs(spark, []), KEY).count() == 0


@pytest.mark.parametrize("day", ["9/9/2019", "09/9/2019", "9/09/2019", "12/9/2019", "9/12/2019", "10/10/2019", "2020-1-31", "2020-01-5", "2020-11-5", "31.1.1999", "1.12.1999", "01.1.1999"])
def test_dates_without_leading_zeros_keep_their_form_and_come_back(day):
    new = replaced(day)[0]
    assert new != day and replaced(new, back=True)[0] == day
    for old_part, new_part in zip(re.split(r"[-/.]", day), re.split(r"[-/.]", new), strict=True):
        assert len(old_part) == len(new_part)
        if len(day) < 10 and len(old_part) < 4:
            assert (old_part[0] == "0") == (new_part[0] == "0")


def test_dates_written_alike_are_permuted():
    """All dates of a form with one-digit months: no two get one pseudonym."""
    days = [f"{m}/{d:02d}/20{y:02d}" for y in range(0, 100, 9) for m in range(1, 10) for d in range(1, 10)]
    assert len({replaced(d)[0] for d in days}) == len(days)


def check_digits(country, body):
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


def test_account_numbers_of_letters_are_found_in_a_table(spark):
    """No text that holds a value of any kind is passed over."""
    account = check_digits("GB", "ABCDEFGHIJK")
    samples = [account, "a.b@example.org", "4111 1111 1111 1111", "078-05-1120", "+49 30 1234567", "192.168.7.9", "2020-1-31"]
    rows = [(i, f"before {s} after", None, None, None) for i, s in enumerate(samples)]
    got = {r.doc_id: r for r in pseudonymise(docs(spark, rows), KEY).collect()}
    assert [got[i].n_found for i in range(len(samples))] == [1] * len(samples)
    assert all(got[i].text != rows[i][1] for i in got) and got[0].text.startswith("before GB")
