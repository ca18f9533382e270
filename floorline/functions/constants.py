"""Fixed values that results depend on, as published."""

WINDOW_MS = 10_000
HOP_MS = 5_000
MIN_SPEECH_MS = 800
AUTOMATIC_THRESHOLD = 0.7
MIN_FOR_CENTRING = 3
INTRUDER_HEADROOM = 2
SPLINTER_EVERY = 25
SPLINTER_MOST = 8
CLARITY_LIMIT = 0.6
CLARITY_MIN_SAMPLES = 3
OVERLAP_LIMIT = 0.3
LOUDNESS_RATIO = 0.45
LOUDNESS_MIN_LEVELS = 4
TINY_SEGMENTS = 2
TINY_MS = 2_000
SAMPLES_PER_SPEAKER = 3
INTRODUCTION_MIN_MS = 5_000
LEARN_DISTANCE = 0.75
FAR_DISTANCE = 0.75
FAR_MIN_SAMPLES = 3
FAR_MIN_MS = 4_000
FAR_WITHIN_MS = 60_000
QUIET_MS = 120_000
BUFFER_MS = 120_000
MAX_FAILURES = 3
MAX_LOG = 4_000
TAIL_MIN_MS = 1_000
STALL_MS = 30_000
DER_FRAME_MS = 10
ASOF_TOLERANCE_MS = 1
OTHER_VOICE = -1
SAMPLE_RATE = 16_000
CLASSES = 7
#: Class of a frame to the local speakers heard in it: none, one of three, two of three.
POWERSET = ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))
EDGE_BUCKETS_MS = (0, 250, 500, 1_000, 2_000)
DURATION_BUCKETS_MS = (0, 1_500, 3_000, 6_000)
SILENCE_BIASES = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
SMOOTHING_GRID = ((0.1, 2000), (0.2, 2000), (0.3, 2000), (0.5, 2000), (0.3, 5000), (0.3, 500))
#: Minutes at which it is looked how many voices distance alone finds.
GROWTH_MINUTES = (1.5, 3, 5, 8, 11, 14, 17.5)
