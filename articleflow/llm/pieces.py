"""Piece table of a public SentencePiece model, and marked words.

The model file is only read (piece strings, scores, byte pieces); neither the
library's encoder nor its decoder is used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARK = "▁"  # fixed value: the symbol that stands for a space


@dataclass
class Pieces:
    """Bounded by the vocabulary file: id and score of each normal piece, the
    256 byte pieces, and how texts may be split without cutting a piece."""
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: list[str]              # by id; '' for control and byte pieces
    unk_score: float
    whole: bool                   # a piece crosses a word's end: do not split
    cuts: str                     # characters that no piece holds
    pattern: str = field(init=False)

    def __post_init__(self):
        cut = re.escape(self.cuts)
        self.pattern = f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|[{cut}]" if cut else "")

    def splitter(self):
        """Function from a text to its marked words, whose pieces joined are
        the pieces of the whole text.  Spaces become marks and one mark goes
        in front; an empty text has no words."""
        find = (lambda s: [s]) if self.whole else re.compile(self.pattern).findall

        def words(text: str | None) -> list[str]:
            return find(MARK + text.replace(" ", MARK)) if text else []
        return words


def load(path: str) -> Pieces:
    """Read a ``.model`` file with byte pieces and identity normalisation."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    ids, scores, byte_ids, texts = {}, {}, [0] * 256, [""] * n
    found = 0
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
            found += 1
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            p = texts[i] = sp.id_to_piece(i)
            ids[p], scores[p] = i, sp.get_score(i)
    if found != 256:
        raise ValueError("the model has no byte pieces; unknown characters could not be encoded")
    crossing = re.compile(f"[^{MARK}]{MARK}")
    used = set("".join(ids))
    return Pieces(ids, scores, byte_ids, texts, min(scores.values()) - 10,
                  any(crossing.search(p) for p in ids), "".join(c for c in "\n\r\t" if c not in used))


def shared(spark, path: str | None = None):
    """The table of ``path`` (default: the public 32k model) as a broadcast;
    its size is the vocabulary's, a few MB at most."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    return spark.sparkContext.broadcast(load(path))
