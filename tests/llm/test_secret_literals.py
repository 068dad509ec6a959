"""Literals are lexed to their real end, behind names and types of any length."""

import random
import string

import pytest

from lattica.llm import secrets


def key(n, seed=1):
    return "".join(random.Random(seed).choices(string.ascii_letters + string.digits, k=n))


def literals(text):
    return [text[s:e] for k, s, e, _ in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize("n", [512, 513, 1600, 4000, 100_000])
@pytest.mark.parametrize("form", ['private_key = "{}"', "private_key = '{}'", "private_key: {}", "private_key={}\n", 'private_key: str = "{}"', 'x = 1; private_key = "ab" + "{}"'])
def test_whole_literals(n, form):
    text = "before\n" + form.format(key(n)) + "\nafter: this"
    assert key(n) not in (out := secrets.redact(text)) and not any(key(n)[i : i + 16] in out for i in range(0, n - 16, max(1, n // 50)))
    assert out.startswith("before\n") and out.endswith("\nafter: this")


@pytest.mark.parametrize(
    "form",
    [
        'passphrase: str = "{}"', 'const passphrase string = "{}"', 'var passphrase []byte = "{}"', 'let passphrase: &\'static str = "{}";', "private passphrase?: string = '{}';",
        'passphrase: Optional[str] = "{}"', 'passphrase: str | None = "{}"', 'const std::string passphrase = "{}";', 'final String passphrase = "{}";', 'char passphrase[64] = "{}";',
        'passphrase = b"{}"', '{{"passphrase": "{}"}}', 'passphrase =' + " " * 200 + '"{}"', "passphrase" + " " * 200 + '= "{}"', "x" * 90 + '_passphrase = "{}"', 'passphrase = """{}"""',
    ],
)
def test_typed_and_distant_names(form):
    assert literals(form.format("q8Zr4TtP0xLm")) == ["q8Zr4TtP0xLm"]


@pytest.mark.parametrize("value", ["q8Zr'4TtP0xLm", 'q8Zr\\"4TtP0xLm', "q8Zr4TtP0xLm\\\\"])
def test_other_and_escaped_quotes(value):
    assert literals(f'passphrase = "{value}" # "end"') == [value]
    assert literals('passphrase = "q8Zr4TtP0xLm\\"\nb = 1') == ["q8Zr4TtP0xLm\\"]


def test_types_are_no_literals_and_padding_is():
    assert literals("passphrase: Optional = None\npassphrase: SecretBox = other") == []
    assert literals("passphrase: YWJjZGVmZ2hpamtsbW5v==\nx") == ["YWJjZGVmZ2hpamtsbW5v=="]
