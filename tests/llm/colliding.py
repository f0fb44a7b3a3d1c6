"""Words that a polynomial hash modulo a power of two cannot tell apart, whatever its base."""


def thue_morse(letters: int = 1024, a: str = "a", b: str = "b") -> tuple[str, str]:
    """The Thue-Morse word and its complement."""
    bits = [bin(k).count("1") & 1 for k in range(letters)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)
