import random

import pytest

from fathom.llm import abuse as A
from fathom.llm import leaks as L

# --- leaks

VOCABULARY = [f"w{i}" for i in range(400)]


def passage(rnd, n=36):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def brute(doc, item, run=12):
    """Whether the two share a run of that many words."""
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                k += 1
            best = max(best, k)
    return best >= run


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(4)
    return [(i, passage(rnd)) for i in range(30)]


@pytest.fixture(scope="module")
def index(items):
    return L.Passages([(i, "question", " ".join(w)) for i, w in items])


def test_window_width_follows_from_the_case():
    p = L.Passages([(1, "question", " ".join(f"a{i}" for i in range(30)))])
    assert (p.width, p.seeds) == (4, 5)


@pytest.mark.parametrize("n", [11, 12, 13, 20])
def test_exact_runs(items, index, n):
    rnd = random.Random(n)
    for i, w in items[:10]:
        at = rnd.randrange(len(w) - n + 1)
        doc = passage(random.Random(i + 500), 200)
        doc[50:50] = w[at : at + n]
        assert [index.items[k] for k, _, _ in index.search(doc)] == ([i] if brute(doc, w) else [])
        assert brute(doc, w) == (n >= 12)


def damaged(w, rnd, every=6):
    out = []
    for p, x in enumerate(w):
        if p % every == every - 1:
            kind = rnd.randrange(4)
            if kind == 0:
                out.append("changed")
            elif kind == 1:
                out += [x[:1], x[1:]]
            elif kind == 2:
                out += [x, "added"]
        else:
            out.append(x)
    return out


def test_damaged_stretches_are_found(items, index):
    rnd = random.Random(9)
    for i, w in items:
        doc = passage(random.Random(i + 900), 100)
        doc[30:30] = damaged(w[:30], rnd, 6)
        assert i in [index.items[k] for k, _, _ in index.search(doc)]


def test_near_copy_beside_a_longer_loose_copy():
    passage = [f"w{i}" for i in range(90)]
    near = [f"x{i}" if i % 5 == 4 and i < 20 else w for i, w in enumerate(passage[60:84])]
    loose = [f"y{i}" if i % 10 in (2, 5, 8) else w for i, w in enumerate(passage[:60])]
    index = L.Passages([(1, "answer", " ".join(passage))])
    for doc in (near, near + ["z"] * 5 + loose):
        assert [k for k, _, _ in index.search(doc)] == [0]
    assert index.search(loose) == []


def edited(w, at, rnd):
    """The words with one edit at each place: changed, broken in two, dropped, or followed by an added word."""
    out = []
    for p, x in enumerate(w):
        kind = rnd.randrange(4) if p in at else None
        out += {None: [x], 0: [f"c{p}"], 1: [x[:1], x[1:]], 2: [], 3: [x, f"a{p}"]}[kind]
    return out


def test_edits_near_the_ends_of_the_shortest_stretch():
    words = [f"w{i}" for i in range(24)]
    index = L.Passages([(1, "answer", " ".join(words))])
    doc = [f"x{i}" if i in (0, 1, 11, 19) else w for i, w in enumerate(words)]
    assert [k for k, _, _ in index.search(["z"] * 9 + doc + ["z"] * 9)] == [0]
    assert [k for k, _, _ in index.search(doc)] == [0]
    worse = [f"x{i}" if i in (1, 5, 11, 15, 19) else w for i, w in enumerate(words)]
    assert index.search(["z"] * 9 + worse + ["z"] * 9) == []


@pytest.mark.parametrize("beside", [0, 3, 50])
def test_no_random_stretch_is_lost(beside):
    """24 to 60 words with an edit in six anywhere, alone or next to a longer loose copy of the same passage."""
    rnd = random.Random(beside)
    passages = [[f"{i}q{j}" for j in range(120)] for i in range(50)]
    index = L.Passages([(i, "answer", " ".join(w)) for i, w in enumerate(passages)])
    docs, want = [], []
    for n in range(1500):
        i, size = rnd.randrange(50), rnd.choice([24, 24, 25, 29, 30, 36, 47, 60])
        at = rnd.randrange(60, 121 - size)
        near = edited(passages[i][at : at + size], set(rnd.sample(range(size), size // 6)), rnd)
        loose = [f"y{k}" if k % 10 in (2, 5, 8) else w for k, w in enumerate(passages[i][:55])]
        docs.append(["z"] * 5 + (loose + ["z"] * beside if beside else []) + near + ["z"] * 5)
        want.append([i])
    got = [[k for k, _, _ in hits] for hits in index.search_many(docs)]
    assert got == want


def test_blocks_of_items_give_what_one_block_gives(spark, items):
    rnd = random.Random(3)
    docs = [(i, " ".join(passage(random.Random(i + 700), 40) + damaged(w[:30], rnd) + w[:15]), 0) for i, w in items]
    d = spark.createDataFrame(docs, "doc_id long, text string, n int").repartition(2)
    e = spark.createDataFrame([(i, " ".join(w), "") for i, w in items], "item_id long, question string, answer string")
    one, many = L.find(d, e), L.find(d, e, block=7)
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() == len(items)


def test_too_much_damage_and_other_sentences(items, index):
    rnd = random.Random(10)
    for i, w in items:
        doc = passage(random.Random(i + 300), 100)
        doc[30:30] = damaged(w, rnd, 3)
        shuffled = w[:]
        rnd.shuffle(shuffled)
        assert index.search(doc) == [] and index.search(doc[:30] + shuffled) == []


def test_near_is_all_within_the_radius(index):
    import numpy as np

    rnd = np.random.default_rng(1)
    probes = np.concatenate([index.prints[:200] ^ (np.uint64(1) << rnd.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 200).astype(np.uint64)), rnd.integers(0, 2**63, 200).astype(np.uint64)])
    i, j = index.near(probes)
    want = {(a, b) for a, p in enumerate(probes) for b, q in enumerate(index.prints) if bin(int(p) ^ int(q)).count("1") <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_words_ignore_form():
    assert L.words("The <b>QUICK</b>,&nbsp;bro​wn fox—and hy-\nphen 58­596 `end_of`.") == ["the", "quick", "brown", "fox", "and", "hyphen", "58596", "endof"]
    assert L.words(None) == L.words(" \n ") == []


def test_long_texts_in_pieces(items, index):
    """Passages anywhere in a long text are found, also where pieces meet, and a text of nothing but common words takes bounded room."""
    import pandas as pd

    for at in (0, 24_990, 24_999, 25_400, 59_000):
        doc = ["lorem"] * 60_000
        doc[at : at + 13] = items[3][1][:13]
        got = {index.items[k] for rows, texts in L._chunks(pd.Series([" ".join(doc)]), 25_000, index.reach) for hits in index.search_many(texts) for k, _, _ in hits}
        assert got == {3}
    assert index.search((items[3][1][:8] + ["x"]) * 3000) == []


def test_find(spark, items):
    docs = [(1, "x " + " ".join(items[0][1])), (1, "x " + " ".join(items[0][1])), (2, None), (3, ""), (4, "lorem " * 50_000 + " ".join(items[1][1][:14]).upper()), (None, " ".join(items[2][1]))]
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, run int, question string")
    e = spark.createDataFrame([(i, " ".join(w), None, "s") for i, w in items] + [(None, "a " * 30, None, "s"), (99, "short one", "", "s")], "item_id long, question string, answer string, text string")
    got = sorted(((r.doc_id or 0), r.item_id) for r in L.find(d, e).select("doc_id", "item_id").distinct().collect())
    assert got == [(0, 2), (1, 0), (4, 1)]
    assert L.find(d.limit(0), e).collect() == [] and L.find(d, e.limit(0)).collect() == []


# --- abuse

BAD = ["You are such an idiot.", "KILL YOURSELF!!!", "y o u r a m o r o n, you m o r o n", "What a st*pid b1tch you are", "you fuuuuucking аsshоlе", "Du bist ein Vollidiot.", "All immigrants are vermin.", "Send me n.u.d.e.s now, send nudes", "Eres un idiota inútil.", "Les étrangers sont des parasites, dehors.", "Les Ã©trangers sont des parasites", "I will find out where\nyou live."]
GOOD = ["This stupid comma cost me an hour.", "I feel like an idiot today.", "First kill the parent process, then reap the zombie.", "The breast cancer table is empty.", "Our policy says abusive posts are removed.", "408 bastard rows have two parents", "The cock valve column is null.", "Bloody hell, you all did great work.", "What is the trend as the batch boundary cuts the group?", "", None, "   ", "The sex column (M, F) is text.", "word " * 20_000, "a b " * 20_000, "x" * 200_000]


@pytest.mark.parametrize("text", BAD)
def test_abusive(text):
    assert A.score_text(text)[2] > 0


@pytest.mark.parametrize("text", GOOD)
def test_harmless(text):
    assert A.score_text(text)[2] == 0


def test_score_is_by_length_and_category():
    one, two = A.score_text("Kill yourself. " + "fine words here " * 10), A.score_text("Kill yourself. " + "fine words here " * 100)
    assert one[0] > two[0] > 0 and one[3] == "abusive" and A.score_text("All migrants are rats.")[3] == "hateful" and A.score_text("Suck my dick.")[3] == "sexual"


def test_scores_and_rates(spark):
    rows = [(1, "Kill yourself.", "a"), (2, "fine", "a"), (3, None, None), (3, None, None), (None, "Kill yourself.", "b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, score int")
    scored = A.score(df)
    assert sorted((r.doc_id or 0, r.abusive_sentences) for r in scored.collect()) == [(0, 1), (1, 1), (2, 0), (3, 0), (3, 0)]
    assert {r.source: (r.documents, r.abusive, r.rate) for r in A.rates(scored).collect()} == {"a": (2, 1, 0.5), None: (2, 0, 0.0), "b": (1, 1, 1.0)}
    assert A.score(df.limit(0)).collect() == []


# Sentences written apart from the lexicon. Before any of them was looked at, 22 of the abusive ones were found and 5 of the harmless ones flagged.
UNSEEN_BAD = """You are the dumbest person I have ever worked with.
What a bunch of imbeciles you all are.
Nobody in this company can stand you, you miserable creep.
I hope you get hit by a truck on your way home.
Come to my desk again and I will break your nose.
You should be ashamed of existing, you little worm.
Women cannot write code, they belong in the kitchen.
Muslims should all be deported before they ruin this country.
Refugees are nothing but parasites living off our taxes.
These people are animals and ought to be put down.
She took off her bra and let him lick her nipples.
I want you naked on my bed tonight, bring your wet pussy.
Shut up, you worthless piece of trash.
Kill yourself, the world would not notice.
You're a p4th3tic l0ser and everyone knows it.
Go choke on something, b*tch.
Jews control the banks and should be wiped out.
I know your address and I am going to hurt your kids.
Du bist so ein dummes Schwein, verpiss dich.
Alle Ausländer sind kriminell und gehören abgeschoben.
Eres un pedazo de mierda y nadie te soporta.
Los inmigrantes son una plaga, que se larguen.
T'es vraiment une grosse merde, ferme ta gueule.
Les Arabes sont tous des voleurs.
He pulled down his pants and she sucked his dick.
Your code is as ugly as your fat face, you cow.
Gays are disgusting and should be locked up.
If you push to main again I'll slit your throat.
Nobody wants a retard like you on the team.
Your mother should be embarrassed for giving birth to you.""".splitlines()
UNSEEN_GOOD = """The moderators removed a comment that told someone to kill themselves.
Her message was deleted because it called another member an idiot.
We banned two accounts for posting 'go back to your country'.
The classifier labels "you are a moron" as abusive.
This bloody compiler is a piece of shit and wasted my day.
I am such an idiot, I forgot the semicolon.
Kill the child process before you start the parent.
The patient reported pain in the breast after sex.
Damn it, the stupid build is broken again.
The master node kills slaves that miss a heartbeat.
Foreign workers are entered in the second table.
The cock crows at dawn in this sample sentence.
Women are under-represented in the survey, so weights were applied.
Shoot me a message when the job is done.
My code is garbage and I should feel bad.
Naked foreign keys hurt you later when tables grow.
Refugees were counted twice in the 2016 load.
You will hate this bug, it kills the whole run.
Sex is stored as M or F, and null where unknown.
He was reported for writing that all foreigners are vermin.""".splitlines()


def test_sentences_written_apart():
    assert sum(A.score_text(t)[2] > 0 for t in UNSEEN_BAD) >= 27
    assert not [t for t in UNSEEN_GOOD if A.score_text(t)[2]]


def test_cover_takes_few_phrases_and_their_sentences():
    found = {"a b c": {(1, 0), (2, 0), (3, 4)}, "b c d": {(1, 0), (2, 0)}, "x y z": {(5, 0), (6, 0)}, "q r s": {(1, 7), (2, 7), (3, 7)}}
    assert A.cover(found, 3) == ["q r s"] and A.cover({}, 3) == []
    del found["q r s"]
    assert A.cover(found, 3) == ["a b c", "b c d"]


def test_fit_learns_what_judgements_share(spark):
    """A frame that no general lexicon knows is learned, spellings of it are found, and harmless, split and empty judgements teach nothing."""
    docs = [(i, f"Some note number {i}. Zorblings of team {i % 3} must eat their soup alone tonight. Fine." if i < 8 else f"Some note number {i}. We eat our soup.") for i in range(40)]
    d = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string")
    labels = [(i, int(i < 8), "hateful" if i < 8 else "none") for i in range(30)] + [(20, 1, "abusive"), (99, 1, "abusive"), (None, 1, "abusive"), (500, 1, "sexual")]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, category string")
    learned = A.fit(d, lab)
    assert learned and {c for _, c in learned} == {"hateful"} and not [p for p, _ in learned if "note" in p]
    got = A.score(d.union(spark.createDataFrame([(100, "Zorblings of team 9 mu5t e4t their s.o.u.p alone tonight")], d.schema)), keep=(), learned=learned)
    assert {r.doc_id for r in got.where("abusive_sentences > 0").collect()} == {*range(8), 100}
    assert A.fit(d, lab.limit(0)) == () and A.fit(d.limit(0), lab) == ()


def test_accuracy_on_labels_held_out(spark, sf):
    """Learned from the judgements of even ids, measured on those of odd ids, some of which err."""
    from fathom.sources.tables import table

    folder = sf.replace("sf0.001", "sf0.1")
    documents, all_labels = table(spark, folder, "documents"), table(spark, folder, "abuse_labels")
    learned = A.fit(documents, all_labels.where("doc_id % 2 = 0"))
    labels = all_labels.where("doc_id % 2 = 1").groupBy("doc_id").agg({"toxic": "min"}).withColumnRenamed("min(toxic)", "toxic")
    got = A.score(documents.join(labels, "doc_id"), keep=("toxic",), learned=learned).collect()
    flagged = [r for r in got if r.abusive_sentences]
    assert sum(r.toxic for r in flagged) / len(flagged) > 0.95
    # raters call some harmless documents toxic, so that not all judged so can be found
    assert sum(r.toxic for r in flagged) / sum(r.toxic for r in got) > 0.65
