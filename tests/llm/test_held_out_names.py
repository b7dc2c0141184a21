"""Sentences and names written by hand, of another make than the test tables', to judge the finder by."""

from corvane.llm.pii import Finder

GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Maria Peter Sofia Lukas Elena Pierre Camille Grace Rose Mark Will Hope".split()
FAMILY = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Peterson Henderson Richardson Robertson Schneider Fischer Hoffmann Baumann Dupont Lefebvre".split()
KNOWN = tuple((n, "given") for n in GIVEN) + tuple((n, "family") for n in FAMILY)
PLAIN = """the a and of to in is was for on with that this from by have had not but what all were when we there can an your which their said if will each
about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way
find use may water long little very after words called just where most know get through back much before go good new write our used me man too any day same right look think also around
another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every
found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together
asked house world going want school important until form food keep children feet land side without boy once animals life enough took sometimes four head above kind began almost live page got earth need far hand high year mother light parts country father let night following
picture being study second eyes soon times story boys since white days ever paper hard near sentence better best across during today others however sure means knew try told young miles sun ways thing whole hear example heard several change answer room sea against top turned learn point city play toward five using himself usually
money seen car morning given ring sorry service phone call office street meeting review update release compiler printer ship battery market report customer manager account reset invoice order ticket garden hope rose mark will grace""".split()
FINDER = Finder(KNOWN, tuple((w, 0.01) for w in PLAIN))

CASES = [
    ("Yesterday I met Mary Johnson at the station.", ["Mary Johnson"]), ("Please ask for Robert, he knows the door code.", ["Robert"]), ("Dr. Watson will see you now.", ["Dr. Watson"]), ("Regards,\nLinda Peterson", ["Linda Peterson"]),
    ("My name is Sofia Hernandez and I need a refund.", ["Sofia Hernandez"]), ("Johnson, Patricia called about the invoice.", ["Johnson, Patricia"]), ("J. R. Henderson wrote the report.", ["J. R. Henderson"]), ("thanks to michael wilson for the fix", ["michael wilson"]),
    ("My landlord David Stephenson keeps the keys.", ["David Stephenson"]), ("Elizabeth K. Moore replied from support.", ["Elizabeth K. Moore"]), ("I told Jessica to reset the router.", ["Jessica"]), ("Herr Hoffmann wohnt nebenan.", ["Herr Hoffmann"]),
    ("Cordialement, Camille Lefebvre", ["Camille Lefebvre"]), ("Me llamo Elena Rodriguez.", ["Elena Rodriguez"]), ("Mrs. Baumann said the garden is closed.", ["Mrs. Baumann"]), ("Both Sarah Davis and Karen Taylor live here.", ["Sarah Davis", "Karen Taylor"]),
    ("WILLIAM ANDERSON owes me money.", ["WILLIAM ANDERSON"]), ("Signed, Thomas", ["Thomas"]), ("Ask for Rose Martinez at the desk.", ["Rose Martinez"]), ("My boss Anna Petersen keeps calling.", ["Anna Petersen"]), ("Prof. Richardson asked for the data.", ["Prof. Richardson"]),
    ("She works with Peter Schneider.", ["Peter Schneider"]), ("Contact Lukas Fischer or Maria Garcia.", ["Lukas Fischer", "Maria Garcia"]), ("Sincerely, Joseph L. Gonzalez", ["Joseph L. Gonzalez"]), ("I am Susan Miller, room 4.", ["Susan Miller"]),
    ("Attention Barbara Lopez, your parcel is here.", ["Barbara Lopez"]), ("Thanks to Grace for fixing it.", ["Grace"]), ("Mein Name ist Lukas Baumann.", ["Lukas Baumann"]), ("Richard Robertson's car is blue, said Charles Brown.", ["Richard Robertson", "Charles Brown"]),
    ("The rose will mark a new hope.", []), ("Will the printer ship today?", []), ("The Grace compiler took long.", []), ("Wilson Labs sold a battery.", []), ("Brown bread and white paper are here.", []), ("Martin Motors has a new car.", []), ("u/James_99 wrote again", []),
    ("Mark the ticket as done.", []), ("Hope is a good thing.", []), ("Ring me in the morning", []), ("Anderson University opened a new line.", []), ("The market went up 3% after the review.", []), ("john@smith.example is my mail", []), ("Rose prices went up again.", []), ("A Taylor guitar is what I want.", []),
]


def test_held_out_names():
    found = right = true = 0
    wrong = []
    for text, names in CASES:
        got = [text[s.start : s.end] for s in FINDER.spans(text) if s.kind == "name"]
        hit = sum(n in names for n in got)
        found, right, true = found + len(got), right + hit, true + len(names)
        if sorted(got) != sorted(names):
            wrong.append((text, got))
    assert right / true >= 0.95 and right / found >= 0.95, (right, true, found, wrong)
