"""Where the vocabulary files are. They stay there; every operator takes a path."""

import os

FOLDER = os.environ.get("QUILLMERE_TOKENIZERS", "/opt/tokenizers")


def path(name: str) -> str:
    return f"{FOLDER}/{name}"
