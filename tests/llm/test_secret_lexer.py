"""The lexer of secret scans: notations, and texts made to be slow."""

from __future__ import annotations

import time

import pytest

from scanmart.llm import secret_scan

VALUE = "Xk29!jQ8#zL0"


def literals(text):
    return [text[i:j] for i, k, j, _, _ in secret_scan.secrets(text) if k == 3]


@pytest.mark.parametrize("line", [
    'password = os.getenv("PW", "{}")', "password = config.get('pw', default('{}'))", 'password = ("{}")', 'password = f"{}"', 'token = rb"{}"',
    'wchar_t *password = L"{}"', 'var secret = @"{}";', '#define PASSWORD "{}"', "#  define DB_PASSWD   '{}'", "<password>{}</password>",
    '<db:password type="x"> {} </db:password>', '<add key="password" value="{}"/>', "{{'name': 'token', 'value': '{}'}}",
    "- name: DB_PASSWORD\n  value: {}", 'password: !!str "{}"', "password: !vault {}", "password: >-\n  {}\nother: 1", "password: |\n    {}",
    'password = """{}"""', "password = '''{}'''", "url: password={}", 'connect(user="me", password="{}")', "conn = connect(host, password='{}')",
    'password = ["{}"]', "token={}&next=1", "x=1&token={}&next=1", 'p = "{}"\nf(1, password=p)', 'p = ("{}")\nq = wrap(p)\nsecret = q',
    "char *password = (char *) \"{}\";", 'password = decode("{}") + ""',
])
def test_notations(line):
    text = "x = 1\n" + line.format(VALUE) + "\ny = 2"
    assert literals(text) == [VALUE]
    assert secret_scan.redacted(text) == text.replace(VALUE, "[SECRET]")


def test_adjacent_literals():
    text = 'password = ("Zx81kQ9-"\n    f"tR44mmB7")\ntitle = "just" "words"\ntoken = "qW3$eR5t" \'yU7!iO9p\''
    assert literals(text) == ["Zx81kQ9-", "tR44mmB7", "qW3$eR5t", "yU7!iO9p"]


def test_what_is_no_literal():
    for text in ('password = os.getenv("DB")', "password = getpass.getpass()", "token = next(tokens)", "<password>", "name: password\nvalue: 1",
                 "x = f(token)", "secret = Secret(kind)", 'title = f("Xk29!jQ8#zL0")'):
        assert not literals(text), text


def test_literals_that_end_together_weigh_the_same():
    text = "token=" * 40 + "a1B!" + "key=x9#Kd8$" * 30
    spans = {(i, len(text)) for i in range(0, len(text) - 1, 3)}
    got = secret_scan.literal_weights(text, spans)
    assert all(abs(got[s] - secret_scan.literal_weight(text[slice(*s)])) < 1e-9 for s in spans)
    digits = "9182736450" * 3
    spans = {(i, 30) for i in range(30)}
    assert secret_scan.literal_weights(digits, spans) == pytest.approx({s: secret_scan.literal_weight(digits[slice(*s)]) for s in spans})


def test_doubled_and_growing_values():
    text = f'a0 = "{VALUE}"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, 41)) + "password = a40\n"
    assert literals(text) == [VALUE]
    assert secret_scan.name_literals(text)[-1] == ("password", [(6, 6 + len(VALUE))])
    text = f'a0 = "{VALUE}"\n' + "".join(f"a{i} = a{i - 1} + 'qq{i}K!xy9'\n" for i in range(1, 20_000)) + "password = a19999\n"
    start = time.time()
    assert len(literals(text)) == 20_000
    assert time.time() - start < 20


@pytest.mark.parametrize("part", [
    "a=b=", "k=v&k=v", "key:", "token=", "token=f(x,", "a=f(", "a=(", "a=b+", 'a="', "x='''", "<password>", "name=token value=", "['a']=",
    "a: b | ", "a=<", "secret: a<", "token: |\n  ab\n", "token \t", "password=.", "a=b(c=", "&a="])
def test_long_unspaced_texts_take_linear_time(part):
    text = "key " + part * ((1 << 20) // len(part))
    start = time.time()
    assert secret_scan.redacted(text) is not None
    assert time.time() - start < 30
