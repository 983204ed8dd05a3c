"""Special tokens and other fixed values shared by every tokenizer.

Fixed values (they must equal the reference tokenizers for identical ids):
  [UNK] = 0, [START] = 1, [END] = 2, [PAD] = 3, [MASK] = 4; first free id 5.
  Character n-gram word markers: start '#', end '+'; default n = 3.
"""

UNK, START, END, PAD, MASK = 0, 1, 2, 3, 4
FIRST_FREE_ID = 5

UNK_TOKEN = "[UNK]"
START_TOKEN = "[START]"
END_TOKEN = "[END]"
PAD_TOKEN = "[PAD]"
MASK_TOKEN = "[MASK]"

# name -> id, in the order the tokenizers register them
SPECIAL_TOKENS = {
    UNK_TOKEN: UNK,
    START_TOKEN: START,
    END_TOKEN: END,
    PAD_TOKEN: PAD,
    MASK_TOKEN: MASK,
}

NGRAM_START_CHAR = "#"
NGRAM_END_CHAR = "+"
NGRAM_N = 3
