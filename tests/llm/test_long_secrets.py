"""Novel secrets of any length and alphabet."""

import random
import string

import pytest

from lotwise.llm import secret_scan

ALPHABETS = {"letters": string.ascii_letters, "lower": string.ascii_lowercase, "digits": string.digits, "base64": string.ascii_letters + string.digits + "+/"}


def clean(text):
    spans = secret_scan.novel_spans(text, text.lower())
    return spans, secret_scan.masked(text, spans)


@pytest.mark.parametrize("kind", ALPHABETS)
@pytest.mark.parametrize("n", [16, 24, 100, 560, 900, 20_000])
def test_whole_secrets(kind, n):
    rng = random.Random(n)
    for _ in range(20):
        key = "".join(rng.choice(ALPHABETS[kind]) for _ in range(n))
        for before in ("Authorization: Bearer ", "the credential is "):
            assert clean(f"{before}{key} and more") == ([(len(before), 3, len(before) + n)], f"{before}[SECRET] and more")


def test_reach_and_names():
    key = "Zx9Qw3Lk7Vb2Nm5Rt8Yp4Hj6"
    for gap, hit in ((secret_scan.REACH, True), (secret_scan.REACH + 1, False)):
        assert bool(clean("bearer" + " " * gap + key)[0]) == hit
    names = ["your_password_here_username", "application_default_credentials", "authorization_header_value", "-" * 900, "0" * 900, "token_" * 200]
    assert not any(clean(f"the credential is {x} here")[0] for x in names)


KNOWN = """communication communications telephone television response responsible responsibility abilities authentication authenticate
authorization service services user interface interfaces component components reference manual chapter documentation docs index
html three section application applications management manager configuration international information network environment
development administration organization university education technology laboratory registration identification description""".split()


def test_words_and_paths_against_keys():
    """With a dictionary of common words, ordinary words and paths behind a sensitive word cost less than their letters in
    random order; random strings of any alphabet do not."""
    import random
    import string

    from lotwise.llm import secret_scan

    dictionary = secret_scan.IDENTIFIERS + " " + " ".join(KNOWN)
    rng = random.Random(8)

    def costly(x):
        text = "Some prose about the deployment of the release and its tests. The credential is " + x + " and it goes on for a while."
        at = text.index(x)
        return secret_scan.costly(text, at, at + len(x), dictionary=dictionary)

    plain = ["responsibilities", "telecommunications", "authentication_service", "user_interface_component", "docs/reference/manual/chapter-three.html", "configuration.management.services", "identification_information", "organization/administration"]
    assert sum(map(costly, plain)) == 0
    for alphabet in (string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_lowercase, "0123456789abcdef", string.digits):
        keys = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 44))) for _ in range(60)]
        assert sum(map(costly, keys)) >= 58
