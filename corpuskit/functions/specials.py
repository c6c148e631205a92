"""Special token ids of the word-id vocabulary.

Word ids are ``rank in the sorted vocabulary + FIRST_WORD_ID``; ids below it are
reserved.  Sentinels for span corruption count down from ``SENTINEL_TOP``.
"""

PAD = 0
EOD = 1  # end of document / sequence (EOS)
UNK = 2
CLS = 3
SEP = 4
MASK = 5
BOS = 6
FIRST_WORD_ID = 100
SENTINEL_TOP = 99
N_SENTINELS = 90  # ids 99 down to 10
IGNORE_LABEL = -100
SPECIAL_IDS = (PAD, EOD, UNK, CLS, SEP, MASK, BOS)


def sentinel(k):
    """Id of the k-th sentinel (k = 0, 1, ...)."""
    return SENTINEL_TOP - k
