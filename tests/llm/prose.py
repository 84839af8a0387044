"""Made-up texts of many distinct words."""

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch".split()


def prose(seed: int, n: int) -> str:
    """n words in a fixed order that depends on the seed."""
    out, state = [], seed * 7919 + 1
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state % 12] + WORDS[state // 12 % 12] + str(state // 144 % 50))
    return " ".join(out)
