from windrow.llm import encoding

with open(encoding.VOCABULARY, "rb") as f:
    ENCODER = encoding.FragmentEncoder(f.read())
