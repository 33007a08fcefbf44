"""They must equal the booking application's for results to agree."""

# --- states, room types, roles, programme types (stored spellings) ---------------------------
ACTIVA = "Activa"
CANCELADA = "Cancelada"
SIN_ASISTENCIA = "Sin Asistencia"
FINALIZADA = "Finalizada"
ESTADOS = (ACTIVA, CANCELADA, SIN_ASISTENCIA, FINALIZADA)
TIPOS_SALA = ("Libre", "Posgrado", "Docente")
TIPOS_PROGRAMA = ("Grado", "Posgrado")
ROLES = ("Estudiante", "Docente")

# --- person labels ---------------------------------------------------------------------------
LABEL_DOCENTE = "Docente"
LABEL_GRADO = "Estudiante de grado"
LABEL_POSGRADO = "Estudiante de posgrado"
LABEL_SIN_PROGRAMA = "Administrativo"
SHORT_GRADO = "Grado"
SHORT_POSGRADO = "Posgrado"
SHORT_SIN_PROGRAMA = "Desconocido"

# --- limits ----------------------------------------------------------------------------------
MAX_NOMBRE = 50
MAX_NOMBRE_SALA = 50
MIN_CAPACIDAD = 1
MAX_CAPACIDAD = 60
MAX_POR_DIA = 2
MAX_POR_SEMANA = 3
GRACIA_MIN = 10
SANCION_MESES = 2

# --- identity numbers, e-mail, accepted characters -------------------------------------------
CI_PESOS = (2, 9, 8, 7, 6, 3, 4)
CI_FORMATO = "^[0-9]{7,8}$"
DOMINIO_ESTUDIANTE = "@correo.ucu.edu.uy"
DOMINIO_PERSONAL = "@ucu.edu.uy"
EMAIL_PROTEGIDO = "administrativo@ucu.edu.uy"
NOMBRE_PERSONA = "^[A-Za-zÀ-ÿ' ]+$"
NOMBRE_SALA = "^[A-Za-z0-9\\s\"']+$"

# --- filter sentinels ------------------------------------------------------------------------
TODOS_EDIFICIOS = "todos"
TODAS_SALAS = "todas"

# --- notification texts ({} is the reservation number) ---------------------------------------
MSG_RESERVA_CANCELADA = "Tu reserva #{} fue cancelada por falta de participantes."
MSG_PARTICIPACION_CANCELADA = "Cancelaste tu participación en la reserva #{}."
MSG_RESERVA_MODIFICADA = "La reserva #{} fue modificada por un administrador."
MSG_SANCION = "Recibiste una sanción por inasistencia."
MSG_SANCION_RESERVA = "Has sido sancionado por inasistencia en la reserva #{}"
