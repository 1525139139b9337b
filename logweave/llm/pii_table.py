"""The small labelled table that the personal-information model is trained on.

Every row is made by rule: a form of writing (prose, assignment, JSON, YAML, XML, CSV, log line,
path), a cue word or none, filler words of which some are made up on the spot, and a value of its
kind.  The value is the labelled span.  Half of the names are made of syllables or of common names,
so that the model does not lean on the gazetteer alone.
"""

from __future__ import annotations

import random
import re
import unicodedata

# Words that announce an item, by kind, in some languages.
CUES = {
    "phone": "phone tel telephone mobile cell fax whatsapp sms hotline callback telefon handy rufnummer durchwahl telefono teléfono móvil movil celular téléphone portable numéro telefoon msisdn pager landline".split(),
    "id_number": "ssn passport passeport pasaporte reisepass ausweis personalausweis dni nie nif nino personnummer steuernummer steuerid siret curp cpf sin nhs licence identification identidad identité social insurance tax fiscal citizen aadhaar bsn".split(),
    "email": "email e-mail mail correo courriel mailto recipient sender reporter cc bcc".split(),
    "name": "name author owner contact customer employee patient reviewer assignee tenant nurse teacher witness applicant subscriber signatory nombre nom cliente kunde".split(),
    "address": "address adresse anschrift dirección domicilio indirizzo adres residence billing shipping delivery home".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr. Sra. Mme Monsieur Madame Mr. Mrs. Dr. Prof. Signora".split()
# What numbers are that belong to no person, and nouns that make a name one of a thing.
NOT_PERSONAL = "order invoice version build release error ticket issue port line row epoch sku serial batch trace span status exit commit tag asset code po bestellung rechnung pedido factura commande facture lot page chapter offset checksum frame job request session shard partition pid".split()
THINGS = "theme edition service cluster dataset library product suite engine plugin board widget track album model printer font router branch palette collection".split()
COMMON_GIVEN = "John Mary James Linda Robert Susan Michael Karen David Nancy Peter Julia Thomas Laura Daniel Emma Paul Sophie Pierre Camille Luc Chloé Jean Inès Hans Greta Jürgen Ute Stefan Anke Carlos Lucía José Carmen Pablo Elena Marco Giulia Paolo Chiara Anna Erik Ingrid Lars Astrid Wei Mei Hiroshi Yuki Raj Priya Omar Fatima Ivan Olga Kofi Amara".split()
COMMON_SURNAMES = "Smith Johnson Brown Taylor Wilson Walker Wright Harris Martin Clark Lewis Young Hill Scott Green Baker Carter Turner Parker Edwards Bernard Durand Moreau Laurent Leroy Roux Müller Schmidt Weber Wagner Becker Hoffmann Schäfer García Martínez López Sánchez Pérez Romero Rossi Russo Ferrari Bianchi Larsson Nilsson Hansen Chen Wang Tanaka Sato Patel Sharma Hassan Ivanov Petrov Kowalski Novak Okafor Mensah".split()
# Filler.
WORDS = "the a one this that every old new slow broken last first after before while when because then again still maybe report sheet queue file user team cache parser worker test patch merge deploy window index note draft plan meeting screen button field table record value key string list count page cursor loop retry timeout buffer thread socket lock scope token branch review summary header footer column row limit check build lint schema query result output input says shows keeps drops moves reads writes fails works waits returns asks needs holds found got set put made sent der die das und mit nach für bitte noch nicht wird ist el la los con para por que no se le les des avec pour dans est pas sur une".split()
NOUNS = "Request Router Error Boundary Cache Layer Session Worker Queue Parser Merge Branch Page Header Model Store Index Table Window Scanner Token Stream Reader Writer Buffer Thread Socket Lock Policy Search Panel Button Field Draft Review Health Probe Retry Budget Export Import Feature Flag Release Notes Data Lake Open Source Pull Event Loop Design Doc Road Map Silver Copper Amber Quiet Bright North River Harbor Forest Meadow Stone Falcon Otter Maple Cedar".split()
CODE = ["if (x == null) return;", "for i in range(10):", "SELECT id, n FROM t WHERE n > 3;", "def run(self, *args):", "const a = b?.c ?? [];", "git rebase -i HEAD~2", "return Ok(());", "#include <vector>", "import os, sys", "npm run build -- --watch", "x = {'a': 1, 'b': [2, 3]}", "<div class=\"row\">ok</div>", "assert len(rows) == 12", "@override", "log.info(f\"{n} done\")", "{% for p in pages %}", "chmod 644 a.txt", "func (s *Store) Get(k string) error {"]
STREETS = "Oak Elm Birch Willow Mill Park Bridge Castle Abbey Orchard Chestnut Lincoln Jefferson Victoria Albert Sunset Lake Spring Water School Market Garden Rose Hawthorn Queen Grove".split()
ENDS = "Street St. St Road Rd Avenue Ave Lane Ln Close Drive Dr Way Court Ct Row Terrace Boulevard Blvd Place Square Crescent".split()
RUES = ["de la Paix", "des Lilas", "Victor Hugo", "du Moulin", "Pasteur", "du Port", "de l'Église", "Saint-Martin", "des Écoles", "Nationale"]
CALLES = ["de Alcalá", "Real", "del Sol", "de la Luna", "San Juan", "Nueva", "de los Reyes", "del Prado", "Colón", "de Goya"]
GERMAN = ["Linden", "Schiller", "Goethe", "Kirch", "Schul", "Berg", "Wald", "Am Alten ", "Friedrich-", "Rosen", "Haupt", "Neue "]
GERMAN_ENDS = ["straße", "strasse", "weg", "gasse", "allee", "platz", "ufer", "str."]
HOSTS = "acme.com mail.org uni-bonn.de gmail.com corp.example post.co.uk firma.at web.de free.fr empresa.es northpole.io labs.test inbox.example.net host.invalid kth.se".split()
USERS = "deploy git root admin build ubuntu runner www postgres ci svc-sync backup".split()


def plain(word: str) -> str:
    """Lower case without accents, as logins are written."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


class Maker:
    """Values, fillers and whole rows, all from one seed."""

    def __init__(self, given: list[str], surnames: list[str], seed: int):
        self.r, self.given, self.surnames = random.Random(seed), given, surnames
        self.foreign = False  # whether the name at hand is to come from outside the gazetteer

    # Parts

    def digits(self, pattern: str) -> str:
        return re.sub("9", lambda _: str(self.r.randrange(10)), pattern)

    def letters(self, n: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def made_up(self, least: int = 2, most: int = 3) -> str:
        return "".join(self.r.choice("b c d f g h k l m n p r s t v w z br dr st tr ch sh".split()) + self.r.choice("a e i o u ai ou ie".split()) for _ in range(self.r.randint(least, most))) + self.r.choice(["", "", "n", "r", "s", "l", "t", "ck", "nd", "son", "ton", "field", "worth", "berg", "ez", "ini", "y"])

    def _part(self, known: list[str], common: list[str]) -> str:
        x = self.r.random()
        if known and x < (0.15 if self.foreign else 0.8):
            return self.r.choice(known)
        return self.r.choice(common) if x < 0.4 or not self.foreign else self.made_up(1, 4).capitalize()

    def given_name(self) -> str:
        return self._part(self.given, COMMON_GIVEN)

    def surname(self) -> str:
        return self._part(self.surnames, COMMON_SURNAMES)

    def name(self) -> str:
        r = self.r
        self.foreign = r.random() < 0.5
        g, s = self.given_name(), self.surname()
        x = r.random()
        if x < 0.12:
            s += "-" + self.surname()
        elif x < 0.24:
            s = r.choice(["von ", "van der ", "van den ", "de la ", "de ", "del ", "du ", "di ", "da ", "O'", "Mc", "ter ", "zu "]) + s
        x = r.random()
        if x < 0.15:
            g = g[0] + "."
        elif x < 0.2:
            g = f"{g[0]}.{r.choice('ABEJKLMRST')}."
        elif x < 0.33:
            g += f" {r.choice('ABEJKLMRST')}."
        elif x < 0.37:
            g += "-" + self.given_name()
        x = r.random()
        if "." not in g and x < 0.25:
            return f"{s.upper() if x < 0.08 else s}, {g}"
        name = f"{g} {s}"
        if self.foreign:  # nothing would tell such a name from ordinary words
            return name
        return name.upper() if x > 0.9 else name.lower() if x > 0.76 else f"{s} {g}" if x > 0.72 else name

    def login(self) -> str:
        r = self.r
        g, s = plain(self.given_name()), plain(self.surname())
        x = r.random()
        if x < 0.1:
            s = r.choice(["vander", "dela", "von", "van", "o", "mc", "de"]) + s
        elif x < 0.18:
            s += "-" + plain(self.surname())
        return r.choice([f"{g}_{s}", f"{g}.{s}", f"{g}-{s}", f"{s}.{g}", f"{s}_{g}", f"{g[0]}{s}", f"{g[0]}{s}", f"{g[0]}.{s}", f"{g[0]}_{s}", f"{s}-{g}"])

    def folder(self) -> str:
        if self.r.random() < 0.45:
            g, s = self.given_name(), self.surname()
            return self.r.choice([g + s, f"{g} {s}", f"{g}.{s}", f"{s}, {g}", s + g])
        return self.login()

    def email(self) -> str:
        r = self.r
        user = r.choice([self.login(), self.login(), plain(self.given_name()) + self.digits("99"), plain(self.given_name()), self.login() + "+" + self.made_up(), self.letters(r.randint(2, 7))])
        host = r.choice(HOSTS) if r.random() < 0.6 else self.made_up() + r.choice(["", "", "-" + self.made_up(), self.digits("9"), self.digits("99"), "." + self.made_up()]) + r.choice([".com", ".test", ".example", ".de", ".org", ".invalid", ".co.uk", ".example.org"])
        x = r.random()
        if x < 0.3:
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("%40", "."), (" AT ", " DOT ")])
            return user + at + host.replace(".", dot)
        mail = f"{user}@{host}"
        return mail.upper() if x > 0.95 else mail.title() if x > 0.92 else mail

    def phone(self) -> str:
        return self.digits(
            self.r.choice(
                "+1-999-999-9999|+1 (999) 999-9999|(999) 999-9999|999-999-9999|999.999.9999|+19999999999|1-999-999-9999|999 999 9999|+44 9999 999999|+44 (0)9999 999999|+44 99 9999 9999|09999 999999|09999 999 999|099 9999 9999|00449999999999|00449999999999|004999999999|0049999999999999|00339999999999|0033999999999|001 999 999 9999|"
                "+49 99 9999999|+49 (0)999 9999999|+49-999-9999999|+49 99 99999 999|0999/9999999|0999 99999999|099 9999-9999|099/99999-999|+33 9 99 99 99 99|09 99 99 99 99|09.99.99.99.99|0999999999|+34 999 999 999|+34 999 99 99 99|999 99 99 99|999 999 999|+39 999 999 9999|+46 99-999 99 99|+81-9-9999-9999|+91 99999 99999|999-9999|+999999999999".split("|")
            )
        )

    def id(self) -> str:
        r = self.r
        text = r.choice("999-99-9999|999-99-9999|999 99 9999|999999-9999|999999+9999|99999999-9999|99/999/99999|999/9999/9999|AA 99 99 99 A|AA999999A|AA 999999 A|A99999999|AAA999999|A9999999A|99999999A|A99A99A99|A9999999|AA9999999|9999 9999 9999 9999|9999-9999-9999-9999|9999999999999999|99 999 999 999|999 999 999|999999999|9999 9999 9999|9 99 99 99 999 999 99|AAAAAA99A99A999A|AAAAA9999A|A9A9A9A9A|99.99.99-999.99|999.999.999-99".split("|"))
        return re.sub("A", lambda _: r.choice("ABCDEFGHKLMNPRSTXYZ"), self.digits(text))

    def address(self) -> str:
        r = self.r
        n = str(r.choice([r.randrange(1, 30), r.randrange(1, 250), r.randrange(1, 250), r.randrange(100, 9999)])) + (r.choice(["a", "b", "A", "C"]) if r.random() < 0.2 else "")
        town, code = self.made_up().capitalize(), self.digits("99999")
        if r.random() < 0.2:
            town = r.choice(["San ", "Saint-", "Bad ", "Port ", "North ", "East "]) + town
        end = r.choice(["", f", {town}", f", {code} {town}", f", {town} {code}", f" in {code} {town}"])
        kind = r.random()
        made = self.made_up().capitalize()
        if kind < 0.15:
            return f"{n}{r.choice([',', '', ' bis'])} {r.choice(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai', 'impasse', 'allée'])} {r.choice([*RUES, made, 'de ' + made, 'des ' + made])}{end}"
        if kind < 0.3:
            return f"{r.choice(['Calle', 'Calle', 'Avenida', 'Plaza', 'Paseo', 'Camino', 'C/', 'Via'])} {r.choice([*CALLES, made, made, 'de ' + made, 'del ' + made, 'de la ' + made, 'de las ' + made, 'de los ' + made])}{r.choice(['', '', ','])} {n}{end}"
        if kind < 0.5:
            head = r.choice([r.choice(GERMAN), r.choice(GERMAN), made, made, f"{made}-{self.made_up().capitalize()}-", f"Sankt-{made}-", f"{r.choice(['Am', 'An der', 'Im', 'Zur'])} {made}"])
            tail = r.choice(GERMAN_ENDS)
            return f"{head}{tail.capitalize() if head.endswith((' ', '-')) else tail} {n}{end}"
        street = " ".join((r.choice(STREETS) if r.random() < 0.5 else self.made_up().capitalize()) for _ in range(r.choice([1, 1, 1, 2])))
        if r.random() < 0.06:
            street = r.choice(["First", "Second", "5th", "22nd", "King's", "St. Mary's"])
        out = f"{n} {street} {r.choice(ENDS)}" + r.choice(["", "", "", " NW", " East"])
        return out + r.choice(["", "", f", Apt {r.randrange(90)}", f", Flat {r.randrange(9)}", f", Unit {r.randrange(99)}"]) + end

    # Filler

    def words(self, least: int, most: int) -> str:
        r = self.r
        return " ".join(self.made_up() if r.random() < 0.4 else r.choice(WORDS) for _ in range(r.randint(least, most)))

    def sentence(self) -> str:
        return self.words(3, 9).capitalize() + self.r.choice([".", ".", "?", "!", ":", ""])

    def secret(self) -> str:
        plain_signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return self.letters(self.r.choice([9, 12, 20, 32, 40]), plain_signs + self.r.choice(["", "", "!#$%*?.-_"]))

    def hexa(self, n: int) -> str:
        return self.letters(n, "0123456789abcdef")

    def none(self) -> str:
        """A stretch without an item, often one that looks as if it had one."""
        r = self.r
        x = r.randrange(26)
        what = r.choice(NOT_PERSONAL)
        if x == 0:
            return f"{what} {r.choice(['number ', 'no. ', '#', '', 'id '])}{self.digits(r.choice('999-99-9999-A 99999 999999-9999 9999999999 999-999-9999-9 99-999-9999 A9999999 999/999 9999-9999'.split())).replace('A', r.choice('XQRC'))}"
        if x == 1:
            return f"{what}{r.choice(['=', ': ', '_id='])}{self.digits(r.choice('999 9999999999 9999999999999 99999999 9999-99-99 9.99.999 99-9-9'.split()))}"
        if x == 2:
            return r.choice(["v", "version ", "release ", "=="]) + self.digits(r.choice("9.99.9 9.9 99.99.9999.9 9999.99.999.9999 9.9.9-rc.9 999.999.9999.9 9999.9.9".split()))
        if x == 3:
            return self.digits(r.choice(["from 99.9.9.99:9999 to 9.9.9.9", "host 199.168.9.99", "99:99:99.999 UTC", "2099-09-09T99:99:99Z", "rows 09999 to 99999", "lines 9-99, 999", "took 9999 ms of 99999", "9999x9999x99", "99/999 done (99.9 %)", "range 999-9999", "on 99/09/2099", "99 + 999 = 9999"]))
        if x == 4:
            host = r.choice(HOSTS)
            return r.choice([f"git clone git@{host}:{self.made_up()}/{self.made_up()}.git", f"ssh {r.choice(USERS)}@{self.made_up()}-{self.digits('99')}.{host}", f"{r.choice(USERS)}@{self.made_up()}:~/{self.made_up()}$ ls", f"[{plain(self.given_name())}@{self.made_up()} src]$ make", f"scp a.txt {r.choice(USERS)}@{host}:/tmp/", f"remote: git@{host}:team/{self.made_up()}.git", f"{plain(self.given_name())}@{self.made_up()}:/var/log# tail x"])
        if x == 5:
            return r.choice(["https", "postgres", "ftp", "amqp", "redis"]) + f"://{r.choice([self.login(), r.choice(USERS)])}:{self.secret()[:12]}@{r.choice(['db.', 'api.', ''])}{r.choice(HOSTS)}:{self.digits('9999')}/{self.made_up()}"
        if x == 6:
            return r.choice([f"https://{r.choice(HOSTS)}/{self.made_up()}?id={self.digits('99999')}", f"npm i {self.made_up()}@{self.digits('9.9.9')}", f"@{self.made_up()}/{self.made_up()}@^{self.digits('9.9')}", f"@{self.made_up()} said so", f"image: {self.made_up()}@sha256:{self.hexa(40)}"])
        if x in (7, 20):
            return r.choice([f"Thanks {self.given_name()}, {self.words(1, 4)}.", f"Hi {self.given_name()},", f"ask {self.given_name()} about {self.words(1, 2)}", f"{self.given_name()} and {self.given_name()} agree.", f"{self.given_name()} said {self.words(2, 3)}", f"cc @{plain(self.given_name())}", f"{r.choice(['from', 'with', 'by', 'for', 'to', 'and', 'von', 'mit'])} {self.given_name()} {self.words(1, 4).capitalize()}", f"{self.words(1, 2)} {self.given_name()} {self.words(2, 4).capitalize()}", f"for {self.given_name()}: {self.words(1, 3)}"])
        if x in (8, 9):
            two = f"{r.choice([self.given_name(), r.choice(STREETS), r.choice(NOUNS), self.made_up().capitalize()])} {r.choice([self.surname(), self.surname(), r.choice(NOUNS)])}"
            return r.choice([f"the {two} {r.choice(THINGS)}", f"{two} is a {r.choice(THINGS)} {r.choice(['name', 'we use', 'of ours'])}", f"{r.choice(THINGS)} {two} {self.words(1, 2)}", f"a {r.choice(THINGS)} called {two}", f"{two} {r.choice(THINGS)} v{r.randrange(9)}"])
        if x in (10, 11, 18, 19):
            caps = " ".join(r.choice(NOUNS) if r.random() < 0.6 else self.made_up(1, 3).capitalize() for _ in range(r.randint(2, 3)))
            return r.choice([f"{self.words(0, 3)} {caps} {self.words(1, 4)}", f"{self.digits('9')} {caps} {self.words(1, 2)}", f"{self.digits('99')} {caps}", f"{caps} {self.digits('99')}", f"{self.made_up().capitalize()} {self.words(1, 2)} {caps}"]).strip()
        if x == 12:
            street = f"{r.choice(STREETS)} {r.choice(ENDS)}"
            return r.choice([f"{street} is {self.words(1, 3)}", f"the {street} {r.choice(THINGS)}", f"{self.words(1, 3)} on {street} {self.words(1, 2)}", f"{self.digits('99')} rows of {self.words(1, 2)} way too slow", f"a {r.choice(['lane', 'row', 'court', 'drive', 'way'])} with {r.randrange(2, 90)} {self.words(1, 2)}", f"the {r.randrange(2, 30)}th {r.choice(['avenue', 'way', 'row'])} of {self.words(1, 2)}"])
        if x == 13:
            return r.choice([f"commit {self.hexa(40)}", f"sha256:{self.hexa(64)}", f"etag \"{self.hexa(32)}\"", f"{self.hexa(8)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(12)}", f"traceparent: 00-{self.hexa(32)}-{self.hexa(16)}-01", f"0x{self.hexa(8)}", f"cache:{self.hexa(12)}:v{r.randrange(9)}"])
        if x == 14:
            return r.choice([f"API_KEY={self.secret()}", f"password: {self.secret()[:10]}!{r.randrange(99)}", f"Bearer {self.secret()}", f"token = \"{self.secret()}\"", f"curl -u {r.choice(USERS)}:{self.secret()[:10]} https://{r.choice(HOSTS)}/x", f"login as {r.choice(USERS)} / {self.secret()[:9]}", f"sshpass -p {self.secret()[:9]} ssh {r.choice(USERS)}@{self.made_up()}.{r.choice(HOSTS)}", f"ssh-rsa {self.secret()}{self.secret()} {r.choice(USERS)}", f"{self.letters(2)}_{self.digits('999999999')}-{self.secret()}"])
        if x == 15:
            return r.choice(CODE)
        if x == 16:
            cue = r.choice([c for cs in CUES.values() for c in cs])
            return r.choice([f"{cue}: null", f"{cue}=\"\"", f"the {cue} field is empty", f"\"{cue}\": {r.randrange(99)}", f"{cue}_count={self.digits('999')}", f"no {cue} given", f"{cue.upper()}=<{cue}>", f"validate {cue} length < {r.randrange(9, 99)}", f"missing {cue} on line {r.randrange(999)}"])
        if x == 17:
            return f"{self.made_up()}/{self.made_up()}_{self.made_up()}.{r.choice(['py', 'rs', 'go', 'md', 'ts', 'sql', 'toml'])}:{r.randrange(999)}"
        return self.sentence()

    # Rows

    def wrapped(self, kind: str, value: str) -> tuple[str, str]:
        """What stands before and after a value."""
        r = self.r
        cue = r.choice(CUES[kind])
        cue = r.choice([cue, cue, cue.capitalize(), cue.upper()])
        key = r.choice([cue, f"{self.made_up()}_{cue}", f"{cue}_{r.choice(['1', 'no', 'number', 'value', 'full', 'work'])}", f"{self.made_up()}{cue.capitalize()}"])
        # A name of unknown parts is none without a word that announces it.
        announced = kind == "name" and self.foreign
        x = r.random() * (0.74 if announced else 1)
        if x < 0.36:
            lead = {
                "phone": [f"{cue} {r.choice(['', 'number ', 'no. ', 'is ', 'at ', 'number is '])}", f"{r.choice(['call', 'ring', 'dial', 'text', 'reach me on', 'try', 'llama al', 'appelez le', 'ruf', 'anrufen unter', 'call back on', 'phone'])} {self.words(0, 1)} ".replace("  ", " "), f"{self.words(1, 2)} on "],
                "id_number": [f"{cue} {r.choice(['', 'number ', 'no. ', 'is ', 'of ', 'number is ', 'nr. ', 'card ', 'id '])}", f"{cue} {r.choice(['security', 'insurance', 'card', 'id', 'identity'])} {r.choice(['', 'number ', 'no ', 'is '])}", r.choice(["social security number ", "national id ", "tax id ", "identity card ", "card number ", "credit card ", "id card no. ", "national insurance ", "numéro de sécurité sociale ", "driving licence ", "carte d'identité ", "his social, ", "her social is "])],
                "email": [f"{cue} {r.choice(['', 'is ', 'to '])}", f"{r.choice(['write to', 'sent to', 'reach', 'from', 'contact', 'drop a note at', 'ping', 'forward it to', 'account', 'user', 'escribe a', 'schreib an', 'écrivez à'])} ", f"{self.words(1, 2)} "],
                "name": [f"{r.choice(TITLES)} ", f"{cue} {r.choice(['', 'is ', 'was '])}", f"{r.choice(['by', 'with', 'from', 'met', 'asked', 'called', 'thanks to', 'signed', 'this is', 'I am', 'for', 'told', 'said', 'talk to', 'spoke to', 'Reviewed by', 'written by', 'approved by', 'meeting with', 'ask', 'von', 'mit', 'de', 'avec', 'con', 'por', 'and', 'to', 'Gruß,', 'Regards,', 'Hello', 'Hallo', 'Merci,', 'Saludos,', 'Best,', 'Cheers,', 'Bonjour', 'Liebe', 'Estimado'])} ", f"{self.words(1, 2)} ", f"{self.made_up().capitalize()}, ", f"{self.made_up().capitalize()} {r.choice(['for', 'of', 'by', 'with', 'to', 'from'])} "],
                "address": [f"{cue} {r.choice(['', 'is ', 'was '])}", f"{r.choice(['lives at', 'living at', 'send it to', 'ship to', 'moved to', 'delivered to', 'wohnt in der', 'wohnhaft', 'vive en', 'habite', 'parcel for', 'located at', 'find us at', 'meet at', 'visit'])} ", f"{self.words(1, 2)} "],
            }[kind]
            before = r.choice(["", self.words(1, 3) + " "]) + r.choice([*lead[:2], r.choice(["met", "asked", "called", "thanks to", "signed", "this is", "I am", "told", "said", "talk to", "spoke to", "Reviewed by", "written by", "approved by", "meeting with", "by", "by", f"{self.made_up()}ed by", "behalf of", "letter from", "message for", "Regards,", "Hello", "Hallo", "Best,"]) + " "] if announced else lead)
            after = r.choice(["", ".", ",", " " + self.words(1, 3), ", " + self.words(1, 4) + ".", " " + self.words(1, 2) + "?", "; " + self.words(1, 2), " (" + self.words(1, 2) + ")", "!"])
            if kind == "name":
                after = r.choice([after, after, r.choice([" wrote", " says", " asked for", " called", " is out", "'s " + self.words(1, 1), " and " + self.words(1, 2), " will " + self.words(1, 2), " reported", " approved", f" {self.made_up()}ed", f" {self.made_up()} {self.words(1, 2)}", " cannot log in", " fragt", " llamó", " a validé"]) + self.r.choice(["", ".", " " + self.words(1, 3)])])
            return before, after
        if x < 0.74:
            q = r.choice(['"', "'"])
            return r.choice([(f"{key}: ", ""), (f"{key}=", r.choice(["", ";", " ", "&"])), (f"{q}{key}{q}: {q}", q + r.choice(["", ",", "}"])), (f"{key} = {q}", q), (f"<{key}>", f"</{key}>"), (f"--{key} ", ""), (f"| {key} | ", " |"), (f"{key}: {q}", q), (f"{{{q}{key}{q}:{q}", f"{q}}}"), (f"{key} -> ", ""), (f"- {key}: ", "\n"), (f"{key}\t", "\t"), (f"// {key}: ", ""), (f"# {key} ", "")])
        if kind in ("id_number", "address") and x < 0.9:
            return f"{r.choice(CUES[kind])} {self.words(1, 2)} ", r.choice([" " + self.words(1, 3), " leaked", " in plain text", ""])
        return r.choice([("['", "']"), ("[\"", "\", \"x\"]"), ("<", ">"), ("(", ")"), (f"{self.digits('99')},", f",{self.made_up()}"), (f"VALUES ({self.digits('9')}, '", "')"), (f"{self.made_up()};", ";"), ("", ""), (f"TODO({'' if kind == 'phone' else ''}", f"): {self.words(1, 3)}"), ("* ", ""), ("> ", "\n"), (f"user {self.digits('99')}: ", ""), (f"[{self.digits('99')}:99] ", ": " + self.words(1, 2))])

    def row(self, kind: str) -> tuple[str, list[tuple[int, int, str]]]:
        """One or two items of a kind among stretches without one."""
        r = self.r
        make = {"name": self.name, "email": self.email, "phone": self.phone, "id_number": self.id, "address": self.address}
        text, spans = "", []
        for k in [kind] + ([r.choice(list(make))] if r.random() < 0.2 else []):
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                text += self.none() + r.choice([" ", " ", "\n", " | "])
            value = make[k]()
            before, after = self.wrapped(k, value)
            text += before
            spans.append((len(text), len(text) + len(value), k))
            text += value + after + r.choice([" ", "\n", " "])
        for _ in range(r.choice([0, 1, 1])):
            text += self.none() + " "
        return text, spans

    def path(self, kind: str | None) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        roots = ["/home/", "/Users/", "/mnt/c/Users/", "C:\\Users\\", "/export/homes/", "/net/home/", "/media/", "/var/users/", "D:\\Profiles\\", "/srv/homes/", "/u/", "~"]
        tail = "".join(r.choice("/\\" if r.random() < 0.05 else "/") + self.made_up() + r.choice(["", "-" + self.made_up(), "_" + self.made_up()]) for _ in range(r.randint(0, 3)))
        if kind is None:
            who = r.choice([*USERS, "shared", "dev", "public", "guest", "builder", "vagrant", "workspace", "me", plain(self.given_name())])
            return r.choice([r.choice(roots) + who, "/opt/" + self.made_up(), "/root", "/workspace", "/srv/ci/" + self.made_up(), "/usr/local/src", "/mnt/d/" + self.made_up(), f"/data/{self.made_up()}-{self.made_up()}", f"/tmp/{self.made_up()}.{self.digits('999')}"]) + tail, []
        value = {"name": self.folder, "email": lambda: self.email().replace(" ", "").lower(), "phone": lambda: self.phone().replace("/", "-")}[kind]()
        root = r.choice(roots[:-1] if kind == "name" else ["/mnt/drive/", "/Volumes/sync/", "/data/mail/", "/home/sso/", "/data/voice/", "/srv/calls/", "/backup/"])
        return root + value + tail, [(len(root), len(root) + len(value), kind)]


def labelled_rows(given: list[str], surnames: list[str], size: int = 560, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their spans (first, end, kind): ``size`` for each kind, and a share without any item."""
    m = Maker(given, surnames, seed)
    rows = [m.row(k) for k in ("name", "email", "phone", "id_number", "address") for _ in range(size * 3 if k == "name" else size)]
    rows += [(" ".join(m.none() for _ in range(3)), []) for _ in range(size)]
    rows += [m.path(k) for k, n in (("name", size), ("email", size // 8), ("phone", size // 8), (None, size // 2)) for _ in range(n)]
    return rows
