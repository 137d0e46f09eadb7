from gridmat.functions import arrays, coords, maps, text

__all__ = ["arrays", "coords", "maps", "text"]
