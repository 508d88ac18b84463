"""Where the public vocabulary files are. Operators take the path as a parameter; these are the queries' values."""

from __future__ import annotations

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
