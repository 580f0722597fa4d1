"""Written forms of personal information in several countries, for training the tagger and for testing it.

Names are common given and family names of several countries, or family names put together from parts; numbers and
addresses follow national forms.  HELD names, forms and sentences are for tests and never trained on.
"""

from __future__ import annotations

import random

# Common given names and family names; the last dozen or so of each list are held out.
GIVEN = (
    "Anna Maria Peter Hans Julia Lukas Sophie Paul Laura Felix Katharina Michael Sabine Jürgen Monika Wolfgang Renate Dieter Ursula Klaus Petra Uwe Heike Jens Anke Björn Silke Torsten Nadine Marco "
    "Emma Olivia James Oliver Jack Emily Grace Harry Charlotte William George Amelia Thomas Sarah David Rebecca Daniel Karen Steven Linda Mark Susan Brian Nancy Kevin Donna Gary Alice Henry Megan "
    "Camille Léa Louis Chloé Hugo Manon Jules Inès Arthur Zoé Pierre Jeanne François Hélène Jean-Luc Marie-Claire Benoît Sylvie Olivier Nathalie Thierry Véronique Didier Céline Guillaume Aurélie Mathieu Élodie "
    "Giulia Matteo Francesca Luca Carmen Javier Lucía Pablo Elif Mehmet Ayşe Emre Fatima Omar Yusuf Leila Priya Arjun Mei Wei Hiroshi Yuki Nguyen Linh Olga Dmitri Agnieszka Piotr Ivana Zoran Ingrid Lars Astrid Sven Kirsten Aino "
    "Max Ida Bo Jo Li Tim Eva Ian Ute Kai Finn Mia Lea Leo Noah Ben Amy Eli Georg Martin Andreas Christian Stefan Birgit Claudia Frank Ralf Jörg Holger Gabriele Ernst Walter Robert Edith Martha Ruth Helen Simon Philip Claire Luc Yves Rosa Marta Elena Ivan Igor Vera Nina"
).split()
FAMILY = (
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Werner Krause Lehmann Köhler Maier "
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Jackson Clarke Patel Khan Lewis Turner Hill Scott Cooper Morris Ward Baker "
    "Martin Bernard Dubois Durand Moreau Laurent Simon Michel Lefebvre Leroy Roux Fournier Girard Bonnet Dupont Lambert Fontaine Rousseau Vincent Muller Lefèvre Faure André Mercier Blanc Guérin Boyer Garnier Chevalier Legrand "
    "Rossi Ferrari Esposito García Fernández López Sánchez Yılmaz Kaya Demir Nowak Kowalski Wójcik Novák Horvat Petrović Ivanov Sokolova Andersson Johansson Nielsen Hansen Virtanen O'Brien O'Connor McDonald van-Dijk Singh Sharma Chen Wang Tanaka Suzuki Kim Park Nguyen Tran Haddad"
).split()
HELD_GIVEN = "Gisela Rüdiger Annegret Detlef Tobias Franziska Beatrice Edward Gareth Philippa Antoine Clémence Gaëlle Fabrice Beatriz Stefano Zeynep Hakan Samira Tariq Katarzyna Bogdan Solveig Rasmus Anjali Kenji".split()
HELD_FAMILY = "Albrecht Böhm Dietrich Engelhardt Friedrich Gruber Holloway Ashworth Bennett Pemberton Whitaker Delacroix Chauvet Marchand Vasseur Bianchi Romano Ortega Çelik Aydın Lewandowski Dvořák Lindqvist Mäkinen Okafor Watanabe".split()
_HEADS = "Alt Berg Burk Dorn Eich Falk Grau Hamm Holl Kalt Kern Land Lind Marsch Mohr Nord Ober Rab Reis Rosen Stein Storm Thal Unter Weid Wend Wies Wint Zell Ash Black Brad Clay Dun East Fair Har Hawk Kings Lang Mill New Ox Pem Rad Stan Thorn West Wood Bel Cour Des Dur Font Gran Lav Mont Ren Ros Val Vern Or Tar Kov Rad Sob Vas Zar".split()
_TAILS = "mann bauer berger hofer meier mayr stein wald feld bach hagen hauser kamp moser rath schmid thaler worth wright ton ley ford field son well wick croft bury den eau ard elle ier ois aud inet court ville ski wicz czyk enko ov ova ić ello ini gren qvist lund sen strand holm dahl".split()

_TOWNS_DE = "Berlin Hamburg München Köln Frankfurt Stuttgart Leipzig Dresden Hannover Nürnberg Bremen Mainz Kassel Ulm Freiburg Potsdam Wien Graz Bern Zürich Altdorf Neustadt Bergheim Oberau Lindenau".split()
_TOWNS_EN = "London Leeds Bristol York Oxford Bath Exeter Norwich Preston Chester Springfield Portland Denver Austin Dayton Milton Ashford Newbury Kendal Whitby".split()
_TOWNS_FR = "Paris Lyon Marseille Lille Nantes Rennes Bordeaux Toulouse Dijon Nancy Metz Tours Angers Brest Pau Saint-Denis Montreuil Fontaine Villeneuve Beaumont".split()
_STREETS = "Haupt Bahnhof Garten Schul Berg Linden Kirch Wiesen Wald Mühlen Rosen Tal Brunnen Birken Ahorn Goethe Schiller Bismarck Post Markt".split()
_ROADS = "High Church Mill Station Victoria Park Green Manor Albert Queens Kings School North South Elm Oak Maple Cedar Bridge Chapel".split()
_VOIES = "de la Gare|Victor Hugo|des Lilas|du Moulin|de la République|Pasteur|des Écoles|du Général Leclerc|de l'Église|Jean Jaurès|des Tilleuls|aux Fleurs|du Port|Saint-Martin|de Verdun|d'Alsace".split("|")


def _n(rng: random.Random, form: str) -> str:
    """``form`` with a random digit for 9, a digit that is not 0 for 8, a capital for A; all else as it is."""
    return "".join(str(rng.randrange(10)) if c == "9" else str(rng.randrange(1, 10)) if c == "8" else rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in form)


def family(rng: random.Random, held: bool = False) -> str:
    if held:
        return rng.choice(HELD_FAMILY)
    if rng.random() < 0.45:
        return rng.choice(FAMILY).replace("-", " ")
    made = rng.choice(_HEADS) + rng.choice(["", "", "", "er", "en", "a", "o", "i"]) + rng.choice(_TAILS)
    return f"{made}-{rng.choice(FAMILY)}" if rng.random() < 0.04 else made


def given(rng: random.Random, held: bool = False) -> str:
    if held:
        return rng.choice(HELD_GIVEN)
    return f"{rng.choice(GIVEN)}-{rng.choice(GIVEN)}" if rng.random() < 0.03 else rng.choice(GIVEN)


def name(rng: random.Random, held: bool = False) -> str:
    g, f = given(rng, held), family(rng, held)
    return rng.choices([f"{g} {f}", g, f"{g[0]}. {f}", f"{f}, {g}", f"{g} {g[0]}. {f}", f"{g} {f}".upper()], [60, 18, 7, 6, 5, 2])[0]


PHONE_FORMS = (
    "+49 30 99999999", "+49 (0)89 9999-999", "+49 171 9999999", "+49-211-999999", "+4969999999", "0049 40 999999", "030/9999999", "089 99 99 99 9", "0221 / 99 99 99", "(040) 999 99 99", "0171 9999999", "0176-99999999", "040-9999999", "0711 9999 999",
    "+43 1 9999999", "+41 44 999 99 99", "+44 20 9999 9999", "+44 (0)161 999 9999", "020 7999 9999", "07899 999999", "01632 999999", "0161 999 9999", "+447899999999", "+1 212 999 9999", "+1-415-999-9999", "(312) 999-9999", "617-999-9999", "503.999.9999", "+1 (206) 999-9999",
    "+33 1 99 99 99 99", "+33 6 99 99 99 99", "01 99 99 99 99", "06 99 99 99 99", "06.99.99.99.99", "0199999999", "0033 4 99 99 99 99", "+39 06 9999 9999", "+34 91 999 99 99", "+48 22 999 99 99", "0151/99999999", "+49 (0) 171 / 999 99 99",
)
HELD_PHONES = ("0171/9999999", "+33 (0)6 99 99 99 99", "312.999.9999", "06-99-99-99-99", "+31 20 999 9999", "+49 (40) 9999999", "0 30 / 999 99 99", "+46 8 999 99 99", "01 99.99.99.99", "+1 202.999.9999", "079 999 99 99", "0800 999 9999")
ID_FORMS = (
    "89 999 999 999", "89999999999", "899-99-9999", "999-89-9999", "1 99 08 75 999 999 99", "2 99 11 69 999 999", "1990875999999", "299116999999999", "12 150890 A 999", "65150890A999", "AA 99 99 99 A", "AA999999A", "756.9999.9999.99", "A89AAA99A", "A9AA9A999", "A8A99A999", "0 99 99 99 999 999 99",
)
HELD_IDS = ("512-99-9999", "078-09-9999", "89 999 999 998", "2 85 07 13 999 999 99", "53 270139 A 999", "AA 12 99 99 A", "756.1999.9999.98", "A01X09A99")
ID_WORDS = ("Steuer-ID", "Steuer-IdNr.", "SSN", "Social Security No.", "N° de sécurité sociale", "NIR", "Personalausweis", "Ausweisnr.", "Passport no.", "Reisepass", "National Insurance", "Rentenversicherungsnummer", "Sozialversicherungsnummer", "AHV-Nr.", "Tax ID", "ID card", "Identity number", "Numéro de passeport")
HOSTS = "example.com example.org mail.example web.example gmail.com outlook.com posteo.de orange.fr free.fr gmx.de firma.example company.co.uk uni.edu post.example".split()


def phone(rng: random.Random, held: bool = False) -> str:
    return _n(rng, rng.choice(HELD_PHONES if held else PHONE_FORMS))


def id_number(rng: random.Random, held: bool = False) -> str:
    return _n(rng, rng.choice(HELD_IDS if held else ID_FORMS))


def email(rng: random.Random, held: bool = False) -> str:
    g, f = (x.lower().replace(" ", "") for x in (given(rng, held), family(rng, held)))
    for a, b in zip("äöüßéèêçñıçšćáíóýłřğş", "a o u s e e e c n i c s c a i o y l r g s".split()):
        g, f = g.replace(a, b), f.replace(a, b)
    local = rng.choice([f"{g}.{f}", f"{g[0]}.{f}", f"{g}{f}", f"{f}{rng.randrange(100)}", f"{g}_{f}", g, f"{f}.{g}", f"{g}+{f}"])
    host = rng.choice(HOSTS)
    return rng.choices([f"{local}@{host}", f"{local} (at) {host}", f"{local}[at]{host.replace('.', '[dot]')}", f"{local} at {host.replace('.', ' dot ')}", f"{local}@{host}".upper()], [84, 5, 4, 4, 3])[0]


def address(rng: random.Random, held: bool = False) -> str:
    comma = rng.choice([", ", ", ", ", ", "\n", ",\n"])
    kind = rng.randrange(4)
    if kind == 0:
        street = rng.choice(_STREETS) + rng.choice(["straße", "str.", "weg", "gasse", "platz", "allee", "ring"]) if rng.random() < 0.75 else rng.choice(["Am ", "An der ", "Im ", "Zum ", "Alter "]) + rng.choice(_STREETS) + rng.choice(["hof", "berg", "tor", "bach", "garten"])
        return f"{street} {rng.randrange(1, 180)}{rng.choice(['', '', '', 'a', ' b', '-9'])}{comma}{_n(rng, '89999')} {rng.choice(_TOWNS_DE)}"
    if kind == 1:
        return f"{rng.randrange(1, 180)}{rng.choice(['', '', ' bis', ','])} {rng.choice(['rue', 'avenue', 'boulevard', 'chemin', 'place', 'impasse', 'allée', 'quai'])} {rng.choice(_VOIES)}{comma}{_n(rng, '89999')} {rng.choice(_TOWNS_FR)}"
    road = f"{rng.randrange(1, 300)} {rng.choice(_ROADS)} {rng.choice('Street Road Lane Avenue Close Drive Way Court Place Terrace Gardens'.split())}"
    if kind == 2:
        return f"{rng.choice(['', '', '', 'Flat 9, '.replace('9', str(rng.randrange(1, 30)))])}{road}{comma}{rng.choice(_TOWNS_EN)} {_n(rng, rng.choice(['AA8 9AA', 'A8 8AA', 'AA89 9AA', 'A89 8AA']))}"
    return f"{road}{comma}{rng.choice(_TOWNS_EN)}, {rng.choice('IL NY CA TX OR WA MA CO OH GA'.split())} {_n(rng, '89999')}"


MAKE = {"email": email, "phone": phone, "id_number": id_number, "address": address, "name": name}


def like(kind: str, old: str, rng: random.Random) -> str:
    """Something generated for what stands there; names keep their form."""
    if kind != "name":
        new = MAKE[kind](rng)
        return new.replace("\n", ", ").replace(",, ", ", ")
    words = old.split()
    if len(words) == 1:
        new = given(rng) if rng.random() < 0.6 else family(rng).split()[-1]
    elif "," in old:
        new = f"{family(rng)}, {given(rng)}"
    elif len(words[0].rstrip(".")) == 1:
        new = f"{given(rng)[0]}. {family(rng)}"
    else:
        new = f"{given(rng)} {family(rng)}"
    return new.lower() if old.islower() else new.upper() if old.isupper() and len(old) > 3 else new


#: Sentences; {x} is personal information of a kind, {O} an organisation or product, {D} a date, {C} a number that is none.
SENTENCES = (
    "Bitte rufen Sie {name} unter {phone} an.", "Meine Nummer ist {phone}, abends {phone}.", "Herr {name} wohnt {address}.", "Die Steuer-ID lautet {id_number}.", "Schreiben Sie an {email} oder an {name}.",
    "Hallo {name},\nkannst du mich morgen unter {phone} erreichen?", "Viele Grüße\n{name}\nTel. {phone}\n{email}", "Lieferung an {name}, {address}, bitte bis {D}.", "Kunde: {name}\nAnschrift: {address}\nTelefon: {phone}\nKundennr. {C}",
    "Ich habe {name} und {name} gefragt, beide waren am {D} nicht da.", "{W}: {id_number}", "{W} {id_number}, ausgestellt am {D}", "Ansprechpartnerin ist Frau {name} ({email}).", "Am {D} schrieb {name} <{email}>:", "Die {O} hat die Bestellung {C} am {D} bestätigt.",
    "Please call {name} on {phone} before {D}.", "My social security number is {id_number}.", "You can reach me at {phone} or {email}.", "Ship it to {name}, {address}.", "Dear {name},\nthank you for order {C} of {D}.", "Best regards\n{name}\n{O}\n{phone}",
    "{name} moved to {address} last year.", "Tell {name} that {name} has the keys.", "Mr {name} and Mrs {name} will join us.", "On {D}, {name} wrote:", "Invoice {C} from {O} is still open.", "Version {V} of {O} was released on {D}.", "Cell {phone} / office {phone}", "The patient, {name}, born {D}, {W} {id_number}.",
    "Bonjour {name},\nvous pouvez me joindre au {phone}.", "Mon adresse : {address}.", "M. {name} habite {address}.", "Son numéro de sécurité sociale est le {id_number}.", "Écrivez à {email}, merci.", "Cordialement,\n{name}\nTél. : {phone}", "Le {D}, {name} a écrit :", "{name} et {name} sont absents jusqu'au {D}.",
    "La facture {C} de {O} n'est pas réglée.", "Nom : {name}\nAdresse : {address}\nPortable : {phone}\nCourriel : {email}", "{name};{phone};{id_number}", "{name}\t{email}\t{phone}", "{name} | {address} | {email}", "Teilnehmer: {name}, {name}, {name}", "Von: {name} <{email}>\nAn: {name} <{email}>\nDatum: {D}",
    "Frag doch {name}.", "Gruß, {name}", "Das hat mir {name} erzählt.", "{name} kommt später.", "Ist {name} heute da?", "Danke, {name}!", "Für {name} liegt ein Paket bereit.", "Die Unterlagen liegen bei {name} im Büro.", "Laut {name} ist alles fertig.", "Mit {name} ist das abgesprochen, mit {name} noch nicht.", "z. Hd. {name}\n{address}", "Postanschrift: {address}",
    "Das Paket geht an {address}.", "Wir ziehen um: {address}.", "Ich bin mobil unter {phone} zu erreichen.", "Fax {phone}, Telefon {phone}", "Rückruf bitte an {phone}!", "Mail: {email}", "Meine neue Adresse ist {email}.", "cc: {email}, {email}", "Nummer des Ausweises: {id_number}", "Bitte tragen Sie {id_number} ein.", "{name}, geboren am {D}, Ausweis {id_number}", "Versichert unter {id_number}.",
    "Ask {name} about it.", "Thanks {name}!", "Hi {name}", "{name} is away until {D}.", "According to {name}, it works.", "I met {name} at the fair.", "Forwarded by {name}", "We live at {address}.", "Our office: {address}", "Send the documents to {address} by {D}.", "Phone: {phone}", "Fax number {phone}, mobile {phone}.", "give me a ring: {phone}", "Write to {email}.", "The number on the card is {id_number}.", "His passport, no. {id_number}, expired on {D}.", "SSN {id_number}",
    "Demandez à {name}.", "Merci {name} !", "Selon {name}, tout est prêt.", "J'ai rencontré {name} hier.", "De la part de {name}", "Nous habitons {address}.", "Envoyez le colis au {address}.", "Appelez le {phone}.", "Mon portable : {phone}", "Répondez à {email}.", "Le numéro de la carte est {id_number}.", "Assuré sous le numéro {id_number}.",
    "Bestellnummer {C}, Kundennummer {C}", "Order no. {C}, customer no. {C}, dated {D}", "Commande {C} du {D}", "Rechnung {C} vom {D} über {C} EUR", "Vorgang {C} ist geschlossen.", "Seriennummer {C}", "Tracking number {C}", "ISBN {C}", "IP 10.0.{V}", "Zimmer {C}", "Konto {C}",
    "Ticket {C}: der Drucker von {O} druckt nicht.", "Siehe https://www.{H}/artikel/{C}?v={V}", "Artikel {C}, Charge {C}, geliefert am {D}.", "Total: {C} EUR, due {D}.", "Error {C} in module {V}", "Die Firma {O} liefert am {D}.", "Der Auftrag {C} wurde storniert.", "The meeting with {O} is on {D} at 14:30.",
)
HELD_SENTENCES = (
    "Könnten Sie bitte {name} informieren? Seine Handynummer: {phone}.", "Zustelladresse ist {address}, zu Händen {name}.", "Der Ausweis mit der Nummer {id_number} gehört {name}.", "Wir haben {name} am {D} getroffen, Auftrag {C}.", "Text me at {phone} or drop a line to {email}.",
    "I spoke with {name} about ticket {C} yesterday.", "Her SSN, {id_number}, was on the form.", "The parcel for {name} goes to {address}.", "Joignez {name} au {phone} avant le {D}.", "Le dossier de {name} porte le numéro {id_number}.", "Veuillez livrer au {address}.", "Contact : {email} ({name})",
)
# Frequent words, of which sentences without sense are made, so that a name is told by itself and not by what stands around it.
_WORDS = (
    "Anlage Arbeit Angebot Antwort Auftrag Ausweis Bericht Bestellung Betrag Bild Blatt Brief Büro Datei Dienst Drucker Ende Ergebnis Fehler Firma Frage Frist Garten Geld Gerät Grund Halle Haus Jahr Kabel Karte Kunde Lager Lampe Leitung Liste Maschine Messe Monat Montag Freitag Muster Nachricht Nummer Ordner Paket Plan Platz Preis Probe Pumpe Rahmen Rechnung Schalter Seite Sommer Stelle Stunde Tisch Tor Tür Unterlagen Ventil Vertrag Wagen Wand Werk Woche Zahl Zeichnung Zeit Zeugnis Zoll "
    "der die das und oder aber mit für von bei nach heute morgen gestern noch schon immer nicht sehr neu alt gut fertig offen bitte danke haben sind wird kann muss soll geht kommt liegt steht fehlt prüfen senden warten holen "
    "the a and or but with for from to at in on of is are was were has have will can must should today tomorrow order part price list report office machine please thanks send check wait open closed new old late early Monday Friday "
    "le la les un une et ou mais avec pour de du des dans sur est sont sera peut doit merci commande prix liste rapport bureau pièce lundi vendredi demain hier nouveau prêt envoyer attendre"
).split()
_ORGS = "Nordlicht GmbH|Blue River Ltd|Acme Inc.|Hansen & Söhne KG|Dupont SARL|Stadtwerke|Green Valley Foods|TechPoint AG|Café Central|Rotes Kreuz|Sparkasse|Office Suite|Windows|Model S|Berliner Zeitung|Northern Railway|Crédit Local|Hotel Adler".split("|")
_DATES = ("99.08.2029", "2024-08-29", "89/08/2024", "8. März 2025", "12 March 2024", "March 8, 2025", "le 8 juin 2024", "08.09.24", "08.08.2024 um 19:39")
_CODES = ("#999999", "NR9999999", "8999999999", "A-99999", "2024-99999", "KD 999999", "999.99", "89.999,99", "A99-999-9999", "89 999", "PK9999999", "4006381999999")


def sentence(rng: random.Random, held: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of one to three generated sentences, and its spans (start, end, kind)."""
    out, spans = "", []
    for i in range(rng.choice([1, 1, 2, 3])):
        form = rng.choice(HELD_SENTENCES if held else SENTENCES)
        if not held and rng.random() < 0.3:
            words = [rng.choice(_WORDS) for _ in range(rng.randrange(2, 12))]
            for _ in range(rng.randrange(0, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["{name}", "{name}", "{name}", "{phone}", "{id_number}", "{email}", "{address}", "{C}", "{D}", "{O}"]))
            form = " ".join(words) + rng.choice([".", "", "!", "?", ":", ","])
        out += ("" if not i else rng.choice([" ", "\n", "\n"]))
        while form:
            before, brace, rest = form.partition("{")
            out += before
            if not brace:
                break
            what, _, form = rest.partition("}")
            if what in MAKE:
                start, text = len(out), MAKE[what](rng, held)
                if what == "phone" and text[0] == "(":
                    start += 1
                out += text
                spans.append((start, len(out), what))
            else:
                out += {"O": lambda: rng.choice(_ORGS), "D": lambda: _n(rng, rng.choice(_DATES)), "C": lambda: _n(rng, rng.choice(_CODES)), "V": lambda: _n(rng, rng.choice(("8.9", "8.9.9", "8.89.9"))), "W": lambda: rng.choice(ID_WORDS), "H": lambda: rng.choice(HOSTS)}[what]()
    return out, spans
