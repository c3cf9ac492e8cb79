"""Frames of the held-out test of the personal-data model; none of them is in the labelled table."""

# Frames with and without personal data.
FRAMES = [
    "The parcel was signed for by {P} at the front desk.", "Our thanks go to {P} and the whole team.", "{P} will take over the night shift.", "Interviewer: {P}", "Yesterday {P} dropped the keys in the letter box.", "The badge of {P} no longer opens the door.", "Witness: {P}, {A}.", "We have heard nothing from {P}.", "Report by {P}; reviewed by {P}.", "Die Schulung hielt {P}.", "{P} übernimmt die Vertretung im Sommer.", "La formation a été donnée par {P}.", "{P} s'occupe du stock.", "El informe lo firma {P}.", "{P} lleva la caja.", "De cursus werd gegeven door {P}.", "{P} regelt de planning.", "O relatório é assinado por {P}.", "{P} trata do armazém.", "Отчёт подписал {P}.",
    "Drop a line to {E} if you cannot come.", "Newsletter copies go out to {E} every month.", "The mailbox {E} is full.", "Bewerbungen an {E} erbeten.", "Les factures vont à {E}.", "Mande la lista a {E}.", "Facturen gaan naar {E}.", "Envie a fatura para {E}.", "Счета отправляйте на {E}.",
    "Ring the doctor on {T}.", "Out of hours: {T}.", "The courier's phone is {T}.", "Notruf: {T}", "Der Hausmeister hat die {T}.", "Le gardien répond au {T}.", "El conserje responde en el {T}.", "De conciërge is te bereiken op {T}.", "O porteiro atende no {T}.", "Сторож отвечает по {T}.",
    "Her identity number is {I}.", "Copy of passport {I} enclosed.", "Kennnummer: {I}", "Le numéro d'identité est {I}.", "DNI {I}.", "BSN: {I}", "NIF {I}", "Номер паспорта {I}.", "Employee's social security no. {I} was entered twice.",
    "The meter at {A} was read today.", "Visitors come to {A}.", "Der Umzug nach {A} ist im Mai.", "Le déménagement au {A} est prévu en mai.", "La mudanza a {A} es en mayo.", "De verhuizing naar {A} is in mei.", "A mudança para a {A} é em maio.", "Переезд на {A} в мае.", "Meet me in front of {A}.",
    "<C> sent a new price list.", "The lift at <S> is broken again.", "Task <K> waits for review.", "Shipment <O> left the harbour.", "File <F> is empty.", "Only <N> chairs are left.", "<D> was printed twice.", "Firmware <V> is out.", "Spare part <R> is on back order.", "Die Lieferung <O> fehlt noch.", "La pièce <R> manque.", "El expediente <K> sigue abierto.",
]
