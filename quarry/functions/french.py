"""The Snowball stemmer for French, after its published description.

``stem`` takes one lower-case word; the full-text index calls it once per distinct word of
an Arrow batch.  Words without a rule (other alphabets, digits) come back unchanged.
"""

from __future__ import annotations

# Fixed values of the published description -----------------------------------------
VOWELS = frozenset("aeiouyâàëéêèïîôûù")
STEP1_DELETE = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
STEP1_ATION = "atrice ateur ation atrices ateurs ations".split()
STEP1_LOG = "logie logies".split()
STEP1_U = "usion ution usions utions".split()
STEP1_ENT = "ence ences".split()
STEP1_EMENT = "ement ements".split()
STEP1_ITE = "ité ités".split()
STEP1_IF = "if ive ifs ives".split()
STEP1_EUSE = "euse euses".split()
STEP1_ISSEMENT = "issement issements".split()
STEP1_MENT = "ment ments".split()
STEP1 = sorted([*STEP1_DELETE, *STEP1_ATION, *STEP1_LOG, *STEP1_U, *STEP1_ENT, *STEP1_EMENT, *STEP1_ITE, *STEP1_IF,
                "eaux", "aux", *STEP1_EUSE, *STEP1_ISSEMENT, "amment", "emment", *STEP1_MENT], key=len, reverse=True)
STEP2A = sorted("""îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is
issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it""".split(),
                key=len, reverse=True)
STEP2B_PLAIN = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
STEP2B_E = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
STEP2B = sorted(["ions", *STEP2B_PLAIN, *STEP2B_E], key=len, reverse=True)
STEP4 = ["ière", "Ière", "ion", "ier", "Ier", "e"]
DOUBLES = ("enn", "onn", "ett", "ell", "eill")
# ------------------------------------------------------------------------------------


def _marked(word: str) -> str:
    """Vowels that act as consonants in upper case; ë and ï as He and Hi."""
    out = list(word)
    for k, c in enumerate(word):
        before = out[k - 1] if k else ""
        after = word[k + 1] if k + 1 < len(word) else ""
        if c == "u" and before == "q":
            out[k] = "U"
        elif c in "ui" and before in VOWELS and before and after in VOWELS and after:
            out[k] = c.upper()
        elif c == "y" and ((before and before in VOWELS) or (after and after in VOWELS)):
            out[k] = "Y"
    return "".join(out).replace("ë", "He").replace("ï", "Hi")


def _after_pair(word: str, start: int) -> int:
    """The place after the first non-vowel that follows a vowel."""
    k = start
    while k < len(word) and word[k] not in VOWELS:
        k += 1
    while k < len(word) and word[k] in VOWELS:
        k += 1
    return min(k + 1, len(word)) if k < len(word) else len(word)


def _regions(word: str) -> tuple[int, int, int]:
    if word[:2] and len(word) > 1 and word[0] in VOWELS and word[1] in VOWELS or word[:3] in ("par", "col", "tap"):
        rv = min(3, len(word))
    else:
        rv = next((k + 1 for k in range(1, len(word)) if word[k] in VOWELS), len(word))
    r1 = _after_pair(word, 0)
    return rv, r1, _after_pair(word, r1)


def _longest(word: str, suffixes: list[str]) -> str | None:
    return next((s for s in suffixes if word.endswith(s)), None)


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """Step 1: the word, and whether one of its special endings asks for step 2a still."""
    s = _longest(w, STEP1)
    if s is None:
        return w, True
    at = len(w) - len(s)
    head = w[:at]

    def ends(text: str, tail: str, region: int) -> bool:
        return text.endswith(tail) and len(text) - len(tail) >= region

    if s in STEP1_DELETE:
        return (head, False) if at >= r2 else (w, True)
    if s in STEP1_ATION:
        if at < r2:
            return w, True
        if head.endswith("ic"):
            return (head[:-2] if ends(head, "ic", r2) else head[:-2] + "iqU"), False
        return head, False
    if s in STEP1_LOG:
        return (head + "log", False) if at >= r2 else (w, True)
    if s in STEP1_U:
        return (head + "u", False) if at >= r2 else (w, True)
    if s in STEP1_ENT:
        return (head + "ent", False) if at >= r2 else (w, True)
    if s in STEP1_EMENT:
        if at < rv:
            return w, True
        if head.endswith("iv"):
            if ends(head, "iv", r2):
                head = head[:-2]
                if ends(head, "at", r2):
                    head = head[:-2]
        elif head.endswith("eus"):
            if ends(head, "eus", r2):
                head = head[:-3]
            elif ends(head, "eus", r1):
                head = head[:-1] + "x"
        elif head.endswith(("abl", "iqU")):
            if len(head) - 3 >= r2:
                head = head[:-3]
        elif head.endswith(("ièr", "Ièr")):
            if len(head) - 3 >= rv:
                head = head[:-3] + "i"
        return head, False
    if s in STEP1_ITE:
        if at < r2:
            return w, True
        if head.endswith("abil"):
            head = head[:-4] if ends(head, "abil", r2) else head[:-2] + "l"
        elif head.endswith("ic"):
            head = head[:-2] if ends(head, "ic", r2) else head[:-2] + "iqU"
        elif ends(head, "iv", r2):
            head = head[:-2]
        return head, False
    if s in STEP1_IF:
        if at < r2:
            return w, True
        if ends(head, "at", r2):
            head = head[:-2]
            if head.endswith("ic"):
                head = head[:-2] if ends(head, "ic", r2) else head[:-2] + "iqU"
        return head, False
    if s == "eaux":
        return head + "eau", False
    if s == "aux":
        return (head + "al", False) if at >= r1 else (w, True)
    if s in STEP1_EUSE:
        return (head, False) if at >= r2 else (head + "eux", False) if at >= r1 else (w, True)
    if s in STEP1_ISSEMENT:
        return (head, False) if at >= r1 and head and head[-1] not in VOWELS else (w, True)
    # the endings after which step 2a follows all the same
    if s == "amment":
        return (head + "ant" if at >= rv else w), True
    if s == "emment":
        return (head + "ent" if at >= rv else w), True
    return (head if head and head[-1] in VOWELS and len(head) - 1 >= rv else w), True


def _verb_i(w: str, rv: int) -> str:
    """Step 2a."""
    s = _longest(w[rv:], STEP2A)
    if s is None:
        return w
    at = len(w) - len(s)
    return w[:at] if at - 1 >= rv and w[at - 1] not in VOWELS and w[at - 1] != "H" else w


def _verb(w: str, rv: int, r2: int) -> str:
    """Step 2b."""
    s = _longest(w[rv:], STEP2B)
    if s is None:
        return w
    at = len(w) - len(s)
    if s == "ions":
        return w[:at] if at >= r2 else w
    if s in STEP2B_E and at - 1 >= rv and w[at - 1] == "e":
        at -= 1
    return w[:at]


def _residual(w: str, rv: int, r2: int) -> str:
    """Step 4."""
    if w.endswith("s") and len(w) > 1 and (w.endswith("His") or w[-2] not in "aiouès"):
        w = w[:-1]
    s = _longest(w[rv:], STEP4)
    if s is None:
        return w
    at = len(w) - len(s)
    if s == "ion":
        return w[:at] if at >= r2 and at - 1 >= rv and w[at - 1] in "st" else w
    return w[:at] if s == "e" else w[:at] + "i"


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    marked = _marked(word)
    rv, r1, r2 = _regions(marked)
    w, go_on = _standard(marked, rv, r1, r2)
    changed = w != marked
    if go_on:
        second = _verb_i(w, rv)
        if second == w:
            second = _verb(w, rv, r2)
        changed, w = changed or second != w, second
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        w = _residual(w, rv, r2)
    if w.endswith(DOUBLES):
        w = w[:-1]
    k = len(w)
    while k and w[k - 1] not in VOWELS:
        k -= 1
    if 0 < k < len(w) and w[k - 1] in "éè":
        w = w[:k - 1] + "e" + w[k:]
    return (w.replace("He", "ë").replace("Hi", "ï").replace("H", "")
            .replace("I", "i").replace("U", "u").replace("Y", "y"))
