"""Bindings that the secret scan's lexer reads, and a plain scan of the base patterns."""

from __future__ import annotations

import random
import re
import time

import pytest

from skewmatch.llm import secrets

S = "zX81kQp0LmWv77aa"
PEM = "-----BEGIN KEY-----\n  MIIEowIBAAKCAQEA7bq\n  93hfGh2Kq0ZpTt81xW\n  -----END KEY-----"


def _lexed(code):
    return [code[a:b] for a, k, b in secrets.spans(code) if k == 3]


@pytest.mark.parametrize("code", [
    f'os.environ["DB_CREDENTIAL"] = "{S}"', f'const credential: string = "{S}"', f"val auth_token: Map<String, String> = '{S}'", f"credential = `{S}`",
    f'credential = """{S}"""', f"credential = r'{S}'", f"<privateKey>{S}</privateKey>", f'<auth.token a="b">\n {S} \n</auth.token>', f'setCredential("{S}")',
    f'conf.set_auth_token( "{S}" )', f'props.put("db.credential", "{S}")', f'class C:\n  K = "{S}"\ncredential = C.K', f'credential = K\nK = "{S}"',
    f'A = "{S}"\nB = A\nx.credential = B', f'x = "{S}"; foo(x="other value 1"); credential = x', f'credential: "{S}"', f"credential => '{S}'", f"credential := {S}",
    f'connect(user="me", credential="{S}")', f'{{"auth": {{"credential": "{S}"}}}}', f"export AUTH_TOKEN={S}", 'private_key = "kqpvhzmwnytxbgfj"'])
def test_bindings(code):
    want = "kqpvhzmwnytxbgfj" if "kqpv" in code else S
    assert [x for x in _lexed(code)] == [want]


def test_pieces_and_blocks():
    assert _lexed('credential = "zX81kQp0" + "LmWv77aa"') == ["zX81kQp0", "LmWv77aa"]
    assert _lexed("credential = ('x')\n'zX81kQp0LmWv77aa'") == []
    assert _lexed(f"name: a\nprivate_key: |\n  {PEM}\nother: b\n") == [PEM]


@pytest.mark.parametrize("code", ["credential = credential", "a = b\nb = a\ncredential = a", "credential = C.K", 'credential = ""', "credential: string", "<credential>",
                                  'if credential == "zX81kQp0LmWv77aa": pass', 'title = "zX81kQp0LmWv77aa"', "the credential: some ordinary words"])
def test_nothing_to_find(code):
    assert _lexed(code) == []


def test_hostile_texts_take_linear_time():
    for unit in ('a="', "a=`", 'a="""', "<a>", "credential: |\n ", "x.y=", 'set("', "a:b<", "(((", "a = b\n", '"a\\', "credential=K;K=credential;"):
        text = unit * (100_000 // len(unit))
        began = time.process_time()
        secrets.spans(text)
        assert time.process_time() - began < 5, unit


def test_base_spans_equal_a_plain_scan():
    rng = random.Random(3)
    parts = ["password", "Api_Key", "apikey", "TOKEN", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12", "0123456789abcdef", "x/y+z.w", "ß", "\n", "secret"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(
            r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
        assert [x for x in secrets.spans(text) if x[1] < 3] == sorted(want)
