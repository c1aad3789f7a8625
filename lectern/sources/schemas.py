"""Explicit schemas; nothing is inferred from data."""

SEGMENT = (
    "audio_filepath string, text string, segment_id string, meeting_id string, split string, duration double, source string, "
    "start double, end double, speaker string, overlap boolean, lang string, quality string, tts_engine string, tts_model string, voice_id string, "
    "video_id string, video_url string, download_date string, sha256 string, label_source string, asr_draft_model string, "
    "reviewed_by string, review_date string, yt_start double, yt_end double, verified boolean"
)
PREDICTION = "segment_id string, meeting_id string, ref string, hyp string"
SWEEP = "lambda double, val_cer double, ood_cer double, val_cer_synthetic double, val_cer_youtube double"
TRAINING = "step long, loss double, learning_rate double, eval_val_loss double, eval_val_cer double, eval_val_wer double, eval_ood_cer double"
JSON3 = "events array<struct<tStartMs: bigint, dDurationMs: bigint, segs: array<struct<utf8: string, tOffsetMs: bigint, acAsrConf: bigint>>>>"
SCRIBE = "words array<struct<text: string, start: double, end: double, type: string, speaker_id: string>>"
DRAFT = "segments array<struct<start: double, end: double, text: string, speaker: string>>"
CAPTIONS = "automatic_captions map<string, array<struct<ext: string, name: string, url: string>>>"
SOURCE = "meeting_id string, video_id string, url string, title string, duration double, sha256 string"
PROBE = "learning_rate double, steps long, warmup_end_step long, first_post_warmup_loss double, min_loss double, final_loss double, rise_frac double, diverged boolean"
