"""Parts of credentials beside base parts."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from halfseen.llm import secrets  # noqa: E402


def kinds(text):
    return [s.split(":")[0] for s in secrets.scan(text.encode())[4].split(",") if s]


def test_endpoint_beside_base_parts_only():
    both = "AKIA" + "B" * 16 + " secret=abcdefgh12 https://db.example.com/x"
    assert kinds(both) == ["access", "assign", "endpoint"]
    assert kinds(both.replace(" https", "\n\nhttps")) == ["access", "assign"]
    assert kinds("secret=abcdefgh12 https://db.example.com/x") == ["assign"]


def test_short_values_of_base_keywords():
    for name in ("password", "passwd", "secret", "token", "api_key", "DB_PASSWORD"):
        assert kinds(f"user=anna {name}=hunter2") == ["ident", "secret"]
        assert kinds(f"{name}=hunter2") == [] and kinds(f"user=anna {name}=abc") == []
    assert secrets.scan(b"user=anna password=hunter2, x")[4] == "ident:0:9,secret:10:26"
    assert kinds("user=anna password=p@ss1") == ["ident", "secret"]
    assert kinds("user=anna&token=ab12&password=longvalue99") == ["ident", "secret", "assign"]
