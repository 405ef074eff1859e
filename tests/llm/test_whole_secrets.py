"""Keys of many lines and long tokens are found to their end."""

import base64
import random

from weftgraph.llm import secret_scan


def _redacted(text):
    raw = text.encode()
    spans = secret_scan.base_spans(raw)
    return secret_scan.redact(raw, spans + secret_scan.Novelty().spans(raw, spans))


def test_whole_keys_go():
    rng = random.Random(5)
    code = base64.b64encode(rng.randbytes(1200)).decode()
    lines = [code[k : k + 64] for k in range(0, len(code) - 60, 64)] + ["q7Zt0A=="]
    body = "\n".join(lines)
    for head in ("", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D4E5F60718293A4B5C6D7E8F9\n\n"):
        text = _redacted(f"Before\n-----BEGIN RSA PRIVATE KEY-----\n{head}{body}\n-----END RSA PRIVATE KEY-----\nafter")
        assert text == "Before\n-----BEGIN RSA PRIVATE KEY-----\n[secret]\n-----END RSA PRIVATE KEY-----\nafter"
    # Without an END marker each line counts from the one before; ordinary words end it.
    text = _redacted(f"-----BEGIN RSA PRIVATE KEY-----\n{body[:650]}\n" + "some ordinary words follow here " * 9)
    assert not any(x[:20] in text for x in lines[:10]) and text.endswith("\n" + "some ordinary words follow here " * 9)


def test_long_tokens_go_to_their_end():
    code = base64.b64encode(random.Random(6).randbytes(9000)).decode().rstrip("=").replace("/", "a").replace("+", "b")
    assert _redacted(f"the bearer {code} and more") == "the bearer [secret] and more"
