"""The small labelled table that the personal-data model is trained on.

Rows are built by rule from sentence frames and value grammars with a fixed
seed: a frame's slots are filled, and the filled slots are the labels. Frames,
name stock and grammars are general knowledge about letters, forms and office
texts and about how the countries write numbers and addresses. Frames without
slots, and slots in angle brackets, are what is *not* personal data:
companies, sites, products, titles, codes, versions, prices.
"""

from __future__ import annotations

import random
import re
import unicodedata

KINDS = ("person", "email", "phone", "id_number", "address")

# Common given names of the languages, and short forms.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Margaret Anthony Sandra Mark Ashley Steven Emily Paul Donna Andrew Michelle Kenneth Carol George Amanda Edward Helen Brian Laura Kevin Samantha Nicholas Katherine Benjamin Victoria Alexander Rachel Jonathan Olivia Stephen Emma Henry Grace Oliver Alice Simon Charlotte "
    "Hans Ursula Peter Monika Wolfgang Sabine Klaus Susanne Jürgen Petra Andreas Birgit Stefan Katharina Martin Julia Johannes Maximilian Felix Leonard Günter Heike Friedrich Ingrid "
    "Jean Marie Pierre Nathalie Michel Isabelle Philippe Catherine Jacques Sylvie François Hélène Étienne Chantal Antoine Camille Luc Margaux "
    "Antonio Carmen José María Manuel Isabel Francisco Dolores Javier Pilar Carlos Lucía Fernando Teresa Miguel Gabriela Diego Elena Alejandro Rosa "
    "Jan Anna Pieter Johanna Willem Cornelia Kees Femke Joost Sanne Maarten Lieke Sven Wilma "
    "Maria João Ana António Joana Rui Catarina Tiago Beatriz Pedro Inês Paulo Sofia Nuno Isabella "
    "Иван Анна Сергей Елена Дмитрий Ольга Андрей Наталья Алексей Татьяна Михаил Мария Николай Екатерина Владимир Светлана Павел Ирина Olga Sergei Ivan Natalia"
).split()
SHORT = "Alex Ben Bill Bob Chris Dan Dave Ed Fred Jack Jim Joe Kate Ken Liz Maggie Matt Max Meg Mike Nick Pat Pete Phil Rick Rob Sam Steve Sue Ted Tom Tony Vicky Will Uli Uwe Toni Pepe Paco Саша Маша".split()
# Legal forms, lines of business, and nouns that names of places and products end in or begin with.
COMPANY = ["Ltd.", "Ltd", "Limited", "GmbH", "AG", "S.A.", "S.L.", "B.V.", "Inc.", "Incorporated", "Corporation", "Corp.", "Company", "Co.", "Group", "Partners", "Holdings", "Industries", "Systems", "Solutions", "Technologies", "Laboratories", "Labs", "Logistics", "Services", "Consulting", "Instruments", "International", "Engineering", "Manufacturing", "Transport", "Foods", "Energy", "Software", "Pharma"]
SHORTENED = ["Mfg.", "Tech.", "Eng.", "Svcs.", "Intl.", "Bros.", "Transp.", "Instr.", "Ind."]
PLACE = "Hill Park Bridge Quay Dock Yard Gate Station Tower House Centre Campus Harbour Point Square Market Mill Wharf Works Plaza Heights Valley Terminal Depot Field Airport".split()
BEFORE = "Port West East North South New Fort Lake Mount Upper".split()
DEVICE = "Reader Pump Scan Desk Rack Meter Kiosk Box Hub Pro Plus Suite Cloud Sensor Printer Drive Router Cart Lift Panel Drill Cam Pad Link Press Works".split()
TITLE_WORDS = ["Agenda", "Annual Report", "Budget", "Checklist", "Contract", "Forecast", "Guide", "Handbook", "Inventory", "Manual", "Minutes", "Newsletter", "Policy", "Proposal", "Report", "Review", "Schedule", "Strategy", "Summary", "Survey", "Training"]
TOPICS = "archive catering customer energy equipment facilities finance health hiring insurance laboratory legal logistics maintenance marketing onboarding payroll privacy procurement quality research safety sales security software staff tax training transport travel warehouse".split()
# Frames with personal data.
FRAMES = [
    # English
    "{P} wrote the first draft and sent it round.", "The interview with {P} lasted an hour.", "Please ask {P} for the spare keys.", "{P} is on leave until Thursday.", "We met {P} and {P} at the trade fair.", "The claim was filed by {P} in March.", "Approved by: {P}", "Attendees: {P}, {P}, {P}", "Author: {P}", "Contact person: {P} ({T})", "Dear {P}, thank you for your letter.", "Kind regards, {P}", "Regards\n{P}", "{P}, who joined in May, runs the help desk.", "According to {P}, nothing has changed.", "{P} called about the invoice.", "cc: {P}", "The desk of {P} is moving to the second floor.", "{P}'s report is missing two pages.", "As agreed with {P}; see below.", "The tenant, {P}, lives at {A}.", "Present were {P} (chair) and {P} (minutes).", "(Source: {P})", "Remark: {P}. The meeting went on.", "Handed to {P}, in person.", "- {P}", "{P}:", "{P}", "{P} repairs the printer, {P} orders paper.", "Substitute for the week is {P}, at extension 12.",
    "Write to {E} for details.", "My new address is {E}, please update it.", "Questions? {E}", "E-mail: {E}", "Mail: {E}; phone: {T}", "Send the signed form to {E} by Friday.", "({E})", "<{E}>", "Reachable under {E} and, in a hurry, {T}.", "{E} bounced twice.", "From: {E}", "The account {E} was locked.", "Subscribers such as {E} get the newsletter.", "{E}",
    "Call {T} after six.", "Her number is {T}.", "Phone {T}, any time.", "Fax: {T}", "Mobile: {T}", "Tel: {T}", "T {T}", "The hotline ({T}) is free of charge.", "He left a message from {T} yesterday.", "New number as of Monday: {T}.", "{T} is engaged all day.", "You may also ring {P} on {T}.", "{T}", "Emergency contact: {P}, {T}",
    "Social security number: {I}", "The passport with the number {I} expires in June.", "ID number {I} was checked at the gate.", "Tax ID {I}", "Identity card no. {I}", "Holder's ID: {I}.", "Please quote your national insurance number ({I}).", "National ID: {I}", "(SSN {I})", "Licence holder {P}, ID {I}", "The form shows {I} as the applicant's number.", "Passport: {I}; born in 1980.", "Insured person {I} has moved.",
    "He lives at {A}.", "Home address: {A}", "The parcel goes to {A}.", "Please deliver to {A} before noon.", "She moved from {A} to {A}.", "Address: {A}", "{A}", "The flat ({A}) is empty.", "Our customer {P}, {A}, complained.", "Post to {P}, {A}.", "Registered at {A} since spring.", "Return address {A}; do not bend.", "Pick-up from {A}.",
    # German
    "{P} hat den Entwurf geschrieben.", "Bitte fragen Sie {P} nach dem Ersatzschlüssel.", "Mit freundlichen Grüßen\n{P}", "Sehr geehrte Frau {P}, vielen Dank.", "Ansprechpartner: {P}", "Laut {P} hat sich nichts geändert.", "Das Gespräch mit {P} dauerte lange.", "Genehmigt von {P}.", "Die Mieterin, {P}, wohnt in {A}.", "Schreiben Sie an {E}.", "E-Mail: {E}", "Telefon: {T}", "Rufen Sie {T} an.", "Ihre Nummer lautet {T}.", "Steuernummer {I}", "Personalausweis Nr. {I}", "Die Ausweisnummer {I} wurde geprüft.", "Sozialversicherungsnummer: {I}.", "Anschrift: {A}", "Er wohnt {A}.", "Das Paket geht an {A}.", "Hinweis: {P}. Der Termin bleibt.", "Am Montag übernimmt {P} die Schicht ({T}).",
    # French
    "{P} a rédigé la première version.", "Demandez les clés à {P}.", "Cordialement,\n{P}", "Selon {P}, rien n'a changé.", "Validé par {P}.", "La locataire, {P}, habite au {A}.", "Écrivez à {E} pour en savoir plus.", "Courriel : {E}", "Tél. : {T}", "Appelez le {T} après six heures.", "Numéro de sécurité sociale : {I}", "La carte d'identité {I} a expiré.", "Passeport n° {I}.", "Adresse : {A}", "Le colis part au {A}.", "Il habite {A}.", "Remarque : {P}. La réunion continue.", "Avec {P} et {P} au salon.",
    # Spanish
    "{P} escribió el primer borrador.", "Pida las llaves a {P}.", "Un saludo,\n{P}", "Según {P}, nada ha cambiado.", "Aprobado por {P}.", "La inquilina, {P}, vive en {A}.", "Escriba a {E} para más detalles.", "Correo: {E}", "Tel.: {T}", "Llame al {T} por la tarde.", "Número de identidad: {I}", "El pasaporte {I} caduca en junio.", "Con el documento {I}.", "Dirección: {A}", "El paquete va a {A}.", "Vive en {A}.", "Observación: {P}. La reunión sigue.",
    # Dutch
    "{P} schreef het eerste concept.", "Vraag {P} om de sleutels.", "Met vriendelijke groet,\n{P}", "Volgens {P} is er niets veranderd.", "Goedgekeurd door {P}.", "De huurder, {P}, woont op {A}.", "Schrijf naar {E} voor meer informatie.", "Mail: {E}", "Telefoon: {T}", "Bel {T} na zessen.", "Burgerservicenummer: {I}", "Het paspoort {I} verloopt in juni.", "Adres: {A}", "Het pakket gaat naar {A}.", "Hij woont aan {A}.", "Opmerking: {P}. De vergadering gaat door.",
    # Portuguese
    "{P} escreveu a primeira versão.", "Peça as chaves a {P}.", "Com os melhores cumprimentos,\n{P}", "Segundo {P}, nada mudou.", "Aprovado por {P}.", "A inquilina, {P}, mora na {A}.", "Escreva para {E} para mais detalhes.", "Correio: {E}", "Telefone: {T}", "Ligue para {T} à tarde.", "Número de contribuinte: {I}", "O passaporte {I} caduca em junho.", "Morada: {A}", "A encomenda vai para {A}.", "Vive na {A}.", "Nota: {P}. A reunião continua.",
    # Russian
    "{P} написал первый вариант.", "Спросите ключи у {P}.", "С уважением,\n{P}", "По словам {P}, ничего не изменилось.", "Утвердил {P}.", "Жилец, {P}, живёт по адресу {A}.", "Пишите на {E}.", "Почта: {E}", "Телефон: {T}", "Звоните {T} после шести.", "Паспорт {I} проверен.", "Номер удостоверения: {I}", "ИНН {I}.", "Адрес: {A}", "Посылка идёт на {A}.", "Замечание: {P}. Собрание продолжается.",
]
# Words that announce a kind, and patterns that they stand in (k the word, v the value, s a plain sentence's beginning).
ANNOUNCED = {
    "T": "phone; telephone; tel.; mobile; cell; fax; hotline; call; ring; dial; phone number; number; extension; Telefon; Handy; Tel.; Rufnummer; Durchwahl; téléphone; tél.; portable; numéro; teléfono; móvil; tel.; número; telefoon; mobiel; nummer; telefone; telemóvel; número; телефон; тел.; моб.; номер".split("; "),
    "I": "passport; passport no.; identity card; ID card; ID; ID no.; identity number; national ID; SSN; social security number; NINO; national insurance number; tax number; TIN; Personalausweis; Ausweis; Ausweisnummer; Reisepass; Steuer-ID; Sozialversicherungsnummer; passeport; carte d'identité; numéro de sécurité sociale; NIR; numéro fiscal; pasaporte; documento de identidad; DNI; NIE; NIF; paspoort; identiteitskaart; BSN; burgerservicenummer; passaporte; cartão de cidadão; NIF; contribuinte; паспорт; удостоверение; СНИЛС; ИНН".split("; "),
    "E": "e-mail; email; mail; mailbox; account; write to; send it to; E-Mail; Mail an; schreiben an; courriel; écrire à; correo; escribir a; e-mail naar; mailen naar; correio; escrever para; почта; писать на".split("; "),
    "A": "address; home address; lives at; moved to; deliver to; residence; Anschrift; Adresse; wohnt in; zieht nach; adresse; habite; livrer au; dirección; domicilio; vive en; adres; woont op; verhuist naar; morada; mora na; entregar em; адрес; живёт по адресу; доставить на".split("; "),
    "P": "of; by; from; with; for; to; and; chair; minutes; signed; contact; author; responsible; tenant; customer; von; bei; mit; für; und; Leitung; Kontakt; par; de; avec; pour; et; chez; por; con; para; y; van; met; voor; en; bij; com; e; от; с; для; и; у".split("; "),
}
# Words that announce a number that is no personal data.
CODES = "order no.; order; invoice; invoice no.; part no.; part number; serial no.; batch; ticket; item; case; reference; shipment; tracking no.; page; line; room; row; code; version; Bestellung Nr.; Bestellnummer; Rechnung Nr.; Teilenummer; Vorgang; Seite; Zeile; Raum; Lieferung; commande n°; facture n°; pièce; dossier; page; ligne; salle; pedido n.º; factura n.º; pieza; expediente; página; línea; sala; bestelling nr.; factuurnummer; onderdeel; zaak; pagina; regel; kamer; encomenda n.º; fatura n.º; peça; processo; página; linha; заказ №; счёт №; деталь; дело; страница; строка".split("; ")
PATTERNS = ["{k}: {v}", "{k} {v}", "({k} {v})", "({k}: {v})", "{s}, {k} {v}.", "{s} ({k} {v}).", "{s}, {k}: {v}", "{s} {k} {v} {t}", "{k} {v} {t}", "{s} {k} {v}.", "{k}: {v}. {s}", "{s} {v} {t}", "{v} {t}", "{s} {k} {v}, {t}", "{v} {t}", "{s}. {v} {t}", "{s}. {v} {t}", "{s} {v} {t}", "/ {v} /", "-- {v}", "| {v} |", "{s} / {v}", "{v}"]
# Frames without personal data.
CLEAN = [
    "<C> delivers on Tuesdays.", "The contract with <C> ends in June.", "{P} works for <C>.", "<C> bought <C> last year.", "<S> opens at nine.", "The <S> needs new batteries.", "We tested <S> and <S>.", "The shuttle to <S> is late.", "Team <S> reports to {P}.", "<D>", "<D> is in the shared folder.", "Read <D> first.", "[<D>] The plan is on track.", "<D> > Part <N>", "See <F> for the figures.", "Attached: <F>, <F>", "Ticket <K> is closed.", "<K> has been moved to room <N>.", "Open points: <K>, <K>.", "Order no. <O> was shipped.", "Order <O> and invoice <R> do not match.", "Part no. <R> is out of stock.", "Serial number <R>, batch <R>.", "Version <V> fixes the bug.", "pkg@<V> is required.", "Ping @support-team about release <V>.", "The price is <N> @ 9.90 each.", "Between <N> and <N> units are left.", "Room <N>, floor <N>.", "The window runs 08:30-12:15 daily.", "On 2030-11-05 the server was down.", "Closed on 05/11/2030.", "Page <N> of <N>.", "Checksum <H>.", "Host 10.0.0.<N> does not answer.", "ISBN 978-0-00-<N>-1.", "Invoice 2030-00<N>.", "The commit <H> breaks the build.", "<W> comes after lunch.", "<W> and <W> are the two project names.", "PLEASE CLOSE THE WINDOWS BEFORE YOU LEAVE THE OFFICE.", "ABOUT <N> OF <N> ITEMS ARE LEFT.", "The Annual Meeting of the Works Council is on Monday.", "The Head of Human Resources signs the form.", "Street lights near the gate are broken.", "The address list and the phone list are out of date.", "No names, please.", "| item | <N> | <K> | <N> |", "Usage: tool --level <N> --out <F>",
    "<C> liefert dienstags.", "Die Bestellung Nr. <O> ist unterwegs.", "Der Vorgang <K> ist erledigt.", "Der Vertrag mit <C> läuft aus.", "Das Lager am Standort <S> ist voll.", "Etwa <N> von <N> Teilen fehlen.", "Die Sitzung der Abteilung Einkauf beginnt um neun.", "Die Heizung im zweiten Stock ist defekt.", "Seite <N> von <N>.", "Der Bericht der Geschäftsführung und die Liste der Termine fehlen.",
    "<C> livre le mardi.", "La commande n° <O> est en route.", "Le dossier <K> est clos.", "Il reste <N> pièces sur <N>.", "La réunion du service Achats commence à neuf heures.", "Voir <F>, page <N>.", "<S> ferme à midi.",
    "<C> entrega los martes.", "El pedido n.º <O> está en camino.", "El asunto <K> está cerrado.", "Quedan <N> piezas de <N>.", "La reunión del departamento de Compras empieza a las nueve.", "<S> abre a las nueve.",
    "<C> levert op dinsdag.", "Bestelling nr. <O> is onderweg.", "Zaak <K> is gesloten.", "Er zijn nog <N> van de <N> stuks.", "De vergadering van de afdeling Inkoop begint om negen uur.",
    "<C> entrega às terças.", "A encomenda n.º <O> está a caminho.", "O processo <K> está fechado.", "Restam <N> peças de <N>.", "A reunião do departamento de Compras começa às nove.",
    "<C> доставляет по вторникам.", "Заказ № <O> в пути.", "Дело <K> закрыто.", "Осталось <N> штук из <N>.", "Собрание отдела закупок начинается в девять.", "Смотрите <F>, страница <N>.",
]
# How the countries write their numbers; N is a digit, L a capital letter, w a name of a street or town.
PHONES = [
    "+44 20 NNNN NNNN", "+44 (0)1NNN NNNNNN", "+44 7NNN NNNNNN", "+4420NNNNNNNN", "020 NNNN NNNN", "01NNN NNNNNN", "07NNN NNNNNN", "+44 20 NNNN NNNN ext. NNN", "+1 (NNN) NNN-NNNN", "+1 NNN NNN NNNN", "(NNN) NNN-NNNN", "NNN-NNN-NNNN", "NNN.NNN.NNNN", "1-NNN-NNN-NNNN", "1.NNN.NNN.NNNN", "+1NNNNNNNNNN", "NNN-NNNN", "+49 NN NNNNNNN", "+49 NNN NNNNN-NN", "0NN/NNNNNNN", "(0NN) NNNNN-NNN", "0NNNNNNNNNN", "0049 NN NNNNNN", "0049/NN/NNNNNN", "+33 N NN NN NN NN", "0N NN NN NN NN", "0N.NN.NN.NN.NN", "+33NNNNNNNNN", "+34 NNN NN NN NN", "+34 NNN NNN NNN", "NNN NNN NNN", "0034 NNN NNN NNN", "+31 NN NNN NNNN", "+31 6 NNNNNNNN", "06-NNNNNNNN", "0NN-NNNNNNN", "0031 NN NNN-NNNN", "+351 NNN NNN NNN", "+351NNNNNNNNN", "00351 NNN NNN-NNN", "+7 (NNN) NNN-NN-NN", "+7 (NNN) NNN NNN", "+7NNNNNNNNNN", "8 NNN NNN NN NN", "8 (NNN) NNN-NN-NN", "007 (NNN) NNN-NNN",
]
IDS = ["NNN-NN-NNNN", "NNN NN NNNN", "LL NN NN NN L", "LLNNNNNNL", "NN NNN NNN NNN", "NNNNNNNNNNN", "LNNLNNNNL", "LNNNNNNNN", "NNNNNNNNL", "NNNNNNNN-L", "NN.NNN.NNN-L", "L-NNNNNNN-L", "LNNNNNNNL", "N NN NN NN NNN NNN NN", "NNNNNNNNNNNNNNN", "NNNNNNNNN", "NNN.NNN.NNN", "NNN NNN NNN", "NN NN NNNNNN", "NNN-NNN-NNN NN", "NNNNNNNNNNNN"]
ADDRESSES = [
    "NN {w} Street, {w}", "NNN {w} Road, {w}, LLN NLL", "NN {w} Lane, {w}bury LLNN NLL", "Flat N, NN {w} Close, {w}", "Apartment NN, NNN {w} Avenue, {w}", "N {w} Court, {w}ham", "NN-NN {w} Gardens, {w}", "NNNN {w} Ave, {w}, LL NNNNN", "NNN West {w} Street, Apt N, {w}ton", "NNN North {w} Blvd, {w}", "NN {w} Drive, {w}, LL NNNNN", "NN {w} St., {w}ford", "Unit N, NN {w} Way, {w}",
    "{w}straße NN, NNNNN {w}", "{w}str. NNN, {w}heim", "{w}weg N, NNNNN {w}dorf", "{w}weg NN a in {w}", "Am {w} NN, NNNNN {w}", "{w}platz N, {w}feld", "{w}allee NN, {w}", "NN rue de {w}, NNNNN {w}", "NN, rue {w}, NNNNN {w}", "N avenue {w}, {w}", "NN bis, boulevard de {w}, NNNNN {w}", "NNN bd {w}, {w}", "N place {w} à {w}", "calle {w}, NN, NNNNN {w}", "Calle de {w} NN, N.º L, {w}", "avenida de {w} NN, {w}", "c/ {w}, nº NN, NNNNN {w}", "plaza {w} N, {w}",
    "{w}straat NN, NNNN LL {w}", "{w}laan NNN, {w}", "{w}kade NN-N, {w}dam", "{w}weg NN, NNNN LL {w}", "{w}plein N in {w}", "rua {w}, NN, {w}", "Rua de {w} NNN, NNNN-NNN {w}", "avenida {w}, NN, N.º esq., {w}", "travessa {w} NN, {w}", "largo de {w} N, {w}", "ул. {w}, д. NN, кв. NN, {w}", "ул. {w}, NN, {w}", "г. {w}, ул. {w}, д. N", "{w} проспект, д. NN, {w}", "{w} ул., NN, {w}",
]
SURNAMES = "Smith Jones Taylor Brown Wilson Evans Walker Wright Robinson Thompson Hughes Edwards Green Hall Wood Harris Clarke Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer Koch Bauer Richter Dubois Moreau Laurent Lefebvre Roux Fournier Girard Mercier García Fernández González Rodríguez López Martínez Sánchez Pérez Jansen Bakker Visser Smit Mulder Bos Silva Santos Ferreira Pereira Oliveira Costa Иванов Петров Смирнов Кузнецов Попов Соколов Иванова Петрова".split()


class _Maker:
    """Values by rule."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, n: int | None = None) -> str:
        """An invented name of some syllables."""
        r = self.r
        out = "".join(r.choice(("b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "br", "st", "tr", "sch", "ch", "j", "x", "c", "q")) + r.choice("aeiouaeioy") for _ in range(n or r.choice((2, 2, 3, 3))))
        return (out + r.choice(("", "", "n", "r", "s", "l", "t", "k", "nd", "m"))).capitalize()

    def cyrillic(self) -> str:
        r = self.r
        return ("".join(r.choice("бвгдзклмнпрст") + r.choice("аеиоу") for _ in range(r.choice((2, 3)))) + r.choice(("", "в", "н", "ск", "й"))).capitalize()

    def number(self, s: str) -> str:
        return re.sub("[NL](?![a-z])", lambda m: str(self.r.randrange(10)) if m.group() == "N" else self.r.choice("ABCDEFGHJKLMNPRSTVWXYZ"), s)

    def surname(self) -> str:
        r = self.r
        x = r.choice(SURNAMES) if r.random() < 0.3 else self.word(r.choice((2, 3, 4)))
        return f"{x}-{self.word(2)}" if r.random() < 0.04 else x

    def person(self) -> str:
        r, s = self.r, self.surname()
        p = r.random()
        g = r.choice(GIVEN) if p < 0.62 else r.choice(SHORT) if p < 0.75 else self.word(r.choice((2, 3)))
        middle = r.choice("ABCDEFGHJKLMNPRSTW") + "."
        title = r.choice(("Mr", "Ms", "Mrs", "Dr", "Mr.", "Mrs.", "Dr.", "Prof.", "Frau", "Herr", "Mme", "M.", "Sra.", "Sr.", "Dhr.", "Mevr."))
        forms = (f"{g} {s}",) * 6 + (f"{s}, {g}", f"{s}, {g}", f"{s.upper()}, {g}", f"{s.upper()}, {g}", f"{s.upper()} {g}", f"{s.upper()} {g}", f"{g} {s.upper()}", f"{g} {s.upper()}", f"{g} {middle} {s}", f"{g[0]}. {s}", f"{g[0]}. {s}", f"{s}, {g[0]}.", f"{title} {s}", f"{title} {s}", f"{title} {g} {s}", f"{s} {g}", f"{g} {self.word(2)} {s}", f"{g} van {s}", f"{g} de {s}")
        return r.choice(forms)

    def email(self) -> str:
        r = self.r
        plain = lambda w: re.sub("[^a-z]", "", unicodedata.normalize("NFD", w.lower()))
        g, s = plain(r.choice(GIVEN)) or "info", plain(self.word(3))
        user = r.choice((f"{g}.{s}", f"{g[0]}.{s}", f"{s}.{g}", f"{g}_{s}", f"{g}{s}", f"{s}{r.randrange(100)}", f"{g}-{s}", f"{s}_{g[:2]}", f"{g}+{r.choice(('news', 'shop', 'work', 'lists'))}", s, g, f"{g[0]}{s}"))
        dom = r.choice((f"{plain(self.word(2))}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'nl', 'pt', 'ru', 'co.uk', 'eu', 'info', 'example', 'test'))}", f"{r.choice(('mail', 'post', 'web', 'office'))}.{plain(self.word(2))}.{r.choice(('com', 'org', 'net', 'example'))}", f"{r.choice(('mail', 'post', 'inbox'))}.{r.choice(('example', 'test', 'example.com', 'example.org', 'example.net'))}"))
        at = r.choice(("@",) * 12 + (" @ ", " at ", " [at] ", "(at)", " (at) ", "[at]"))
        if "at" in at:
            dom = dom.replace(".", r.choice((" dot ", " [dot] ", "(dot)", ".", " (dot) ")))
        out = user + at + dom
        return out.upper() if r.random() < 0.1 else out

    def address(self) -> str:
        s = self.number(self.r.choice(ADDRESSES))
        make = self.cyrillic if re.search("[а-я]", s) else lambda: self.word(self.r.choice((2, 3)))
        out = s.replace("{w}", "\0")
        while "\0" in out:
            out = out.replace("\0", make(), 1)
        return out.upper() if self.r.random() < 0.03 else out

    def company(self) -> str:
        r = self.r
        a, b = self.surname(), self.word()
        return r.choice((f"{a} {r.choice(COMPANY)}", f"{a} {r.choice(COMPANY[14:])} {r.choice(COMPANY[:14])}", f"{a} & {b}", f"{a} & {b} {r.choice(COMPANY)}", f"The {a} {r.choice(COMPANY[14:])}", f"{a}, {b} & {r.choice(('Sons', 'Partners'))}", f"{a} {r.choice(SHORTENED)}", f"{a} {b} {r.choice(COMPANY)}", f"{a} {r.choice(SHORTENED)} {r.choice(COMPANY[:14])}"))

    def site(self) -> str:
        r, w = self.r, self.word()
        return r.choice((f"{w} {r.choice(PLACE)}", f"{w} {r.choice(PLACE)}", f"{r.choice(BEFORE)} {w}", f"{w} {r.choice(DEVICE)}", f"{w} {r.choice(DEVICE)}", f"{w}{r.choice(DEVICE).lower()}", f"{w} {self.number('NNN')}", f"{w}{r.choice(DEVICE).lower()} {self.number('NN')}", w))

    def title(self) -> str:
        r = self.r
        return f"{r.choice(TITLE_WORDS)} {r.choice(TOPICS)}" + r.choice(("", f" {self.word()}", f" {self.word()} {self.word()}", self.number(" 20NN"), self.number(" QN 20NN"), f" {self.word()} {self.word()}" + self.number(" 20NN")))

    def fill(self, slot: str) -> str:
        r = self.r
        return {
            "P": self.person,
            "E": self.email,
            "T": lambda: self.number(r.choice(PHONES)),
            "I": lambda: self.number(r.choice(IDS)),
            "A": self.address,
            "C": self.company,
            "S": self.site,
            "K": lambda: self.number(r.choice(("LL-NNNN", "LL-NNN", "LLL-NN", "LNNN", "LL-NNNNN"))),
            "N": lambda: self.number(r.choice(("NN", "NNN", "NNNN", "NNNNN", "N"))),
            "V": lambda: self.number(r.choice(("N.N.N", "vN.NN.N", "NN.NN", "N.NN.NN"))),
            "R": lambda: self.number(r.choice(("NN-NNNN", "NNNNNN", "LL-NN-NNNN", "NNN-NNN", "PN NNN-NNNN", "NNNN/NN", "LLNNN", "NNNNN-LL"))),
            "O": lambda: self.number(r.choice(("NNNN-NN-NNNN", "NNNN NNNN NNN", "NNNNNNN", "NNNN-NNNNN", "LLNNNNNN"))),
            "D": self.title,
            "F": lambda: self.number(r.choice(("scan_NNNN.tiff", "report-NN.pdf", "img_NNNNN.png", "list.NNNN.csv", "a/b_NN.txt"))),
            "W": self.word,
            "H": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((7, 8, 12, 16, 32)))),
        }[slot]()


def _announced(r: random.Random, plain: list[str]) -> str:
    """A frame put together from an announcing word, a slot and parts of plain sentences."""
    slot = r.choice("PPPPETTIIIAA....")
    words = [w for w in re.sub(r"[{}<>]", "", r.choice(plain)).rstrip(".!?").split()]
    at = r.randrange(1, len(words)) if len(words) > 1 else 1
    got = r.choice(PATTERNS).replace("{k}", r.choice(ANNOUNCED[slot] if slot != "." else CODES)).replace("{s}", " ".join(words[:at])).replace("{t}", (" ".join(words[at:]) or "still holds").rstrip(",;:") + ".")
    if slot == ".":
        code = r.choice("OORRNNKVH")
        return got.replace("{v}", r.choice((f"<{code}>", f"<{code}>", f"<{code}>, {r.choice(CODES)} <{code}>")))
    return got.replace("{v}", "{" + slot + "}")


def _inserted(r: random.Random, sentence: str) -> str:
    """A plain sentence with a slot anywhere in it: what stands beside a value must not decide what it is."""
    words = re.sub(r"[{}<>]", "", sentence).split(" ")
    at = r.randrange(len(words) + 1)
    slot = "{" + r.choice("PPPETTIIAA") + "}" if r.random() < 0.6 else "<" + r.choice("CCSSDDKORNWVF") + ">"
    slot = r.choice((slot, slot, slot, slot + ",", f"({slot})", f"{slot}.", f"{slot}:"))
    return " ".join([*words[:at], slot, *words[at:]])


# What a sentence must not hold to count as free of personal data.
SUSPECT = re.compile(
    r"@\w|\w@|\bat\b[^.]*\bdot\b|[\[(](?:at|dot)[\])]|\b(?:Mr|Ms|Mrs|Dr|Prof|Frau|Herr|Mme|Sra?|Dhr|Mevr)\b|\b[^\W\d_]\. ?(?:[^\W\d_]\. ?)?[^\W\d_a-z]\w+|\+\d|\d[\d ./()-]{5,}\d|\b[A-Z]{1,2} ?\d\d ?\d\d|\d{5}"
    r"|\d[ ,]+(?:bis |rue|bd |place|North|South|East|West|\w+ (?:St|Street|Lane|Road|Close|Court|Ave|Avenue|Blvd|Drive|Way))|(?:straße|str\.|weg|platz|allee|straat|kade|laan|plein) \d|\b(?:rue|avenue|bd|calle|c/|rua|travessa|avenida|plaza|ул\.|Am [A-Z]\w+ \d|Flat|Apt)\b"
)
NAMES = {w.casefold() for w in (*GIVEN, *SHORT)}


def clean_sentences(texts: list[str], most: int, common=frozenset()) -> list[str]:
    """Different sentences of the texts that hold nothing suspect: the labelled table's examples of plain text.

    ``common`` holds the words that are frequent or mostly small in the whole
    corpus; neighbours with capitals that are not in it could be a name.
    """
    out: dict[str, str] = {}
    for t in texts:
        for line in t.split("\n"):
            for x in re.split(r"(?<=[.!?]) +(?=[^a-z])", line):
                words = re.findall(r"\w+", x)
                if not 2 <= len(words) <= 40 or SUSPECT.search(x) or any(w.casefold() in NAMES for w in words):
                    continue
                if not x.isupper() and any(w.isupper() and len(w) > 3 for w in words):
                    continue
                rare = [w[0].isupper() and w.casefold() not in common for w in words]
                if any(a and b for a, b in zip(rare, rare[1:])):
                    continue
                out.setdefault(re.sub(r"\d", "0", x), x)
        if len(out) > 6 * most:
            break
    xs = sorted(out.values())
    random.Random(5).shuffle(xs)
    return xs[:most]


NEUTRAL = ["The lift is out of order.", "We painted the kitchen last week and ordered new chairs.", "The plants in the hall need water twice a month.", "Der Aufzug bleibt bis Freitag außer Betrieb.", "Bitte bringen Sie die Unterlagen zum nächsten Termin mit.", "La cuisine a été repeinte la semaine dernière.", "Les plantes du couloir ont besoin d'eau.", "La cocina se pintó la semana pasada.", "Las plantas del pasillo necesitan agua.", "De keuken is vorige week geverfd.", "De planten in de gang hebben water nodig.", "A cozinha foi pintada na semana passada.", "As plantas do corredor precisam de água.", "Кухню покрасили на прошлой неделе.", "Растения в коридоре нужно поливать.", "Overall, the plan holds (AB-1234).", "Zur Erinnerung: das Lager ist voll.", "En bref, le plan tient.", "- The coffee machine works again.", "About 12 hours remain."]


def labelled_rows(copies: int = 7, seed: int = 11, plain: list[str] | tuple = (), frames: list[str] | tuple = ()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)…]): every frame ``copies`` times twice as many made of announcing words and, for each plain sentence, one with a value anywhere in it; many next to a plain sentence, some shouted; then the plain sentences. Other ``frames`` may stand in for the table's own."""
    m = _Maker(seed)
    kinds = dict(zip("PETIA", KINDS))
    plain = list(plain) or NEUTRAL
    out = []
    for turn in range(copies):
        made = [_announced(m.r, plain) for _ in range(2 * len(FRAMES))] + [_inserted(m.r, x) for x in (plain if len(plain) < 300 else plain[turn::copies])]
        for frame in frames or (*FRAMES, *CLEAN, *made):
            text, spans = "", []
            if m.r.random() < 0.45:
                text = m.r.choice(plain) + m.r.choice((" ", " ", "\n", ", "))
            if m.r.random() < 0.1 and frame[0] != "[":
                text = m.r.choice(("[Scope] ", "[Part B] ", "- ", "# Costs\n", "[Summary] ", "> ", "1. ")) + text
            # the values also stand in brackets, dashes or after a comma, whatever the frame's words are
            if "{" in frame and len(frame) > 12 and m.r.random() < 0.3:
                slot = re.search(r"\{[PETIA]\}", frame).group()
                frame = re.sub(r"[{}<>]", "", m.r.choice(plain)).rstrip(".") + m.r.choice((f" ({slot}).", f", {slot}.", f" – {slot}.", f": {slot}", f"; {slot}.", f" [{slot}]", f", cc {slot}."))
            if m.r.random() < 0.45 and frame[-1] in ".}":
                frame += m.r.choice((" ", " ", "\n")) + re.sub(r"[{}<>]", "", m.r.choice(plain))
            for part in re.split(r"(\{[PETIA]\}|<[CSKNVRDFWHO]>)", frame):
                if len(part) == 3 and part[0] in "{<":
                    v = m.fill(part[1])
                    if part[0] == "{":
                        spans.append((len(text), len(text) + len(v), kinds[part[1]]))
                    text += v
                else:
                    text += part
            if m.r.random() < 0.04 and len(text.upper()) == len(text):
                text = text.upper()
            out.append((text, spans))
    for a in range(0, len(plain), 2):
        out.append((" ".join(plain[a : a + 2]), []))
    return out
