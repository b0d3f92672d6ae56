"""Row types. Open tails are VARIANT, so records with other keys read without a change of schema."""

PROBLEM = "example_id string, dataset string, problem string, gold_answer string, answer_mode string, choices array<string>, metadata variant"
POOL = PROBLEM + ", candidates array<string>"
PREDICTION = "example_id string, prediction string, gold_answer string, answer_mode string, correct boolean"
SCORED = PREDICTION + ", candidates array<struct<candidate_index:int,candidate_answer:string,yes_score:double,no_score:double,margin:double>>"
TRACE = "example_id string, dataset string, problem string, gold_answer string, teacher_model string, teacher_trace string, teacher_final_answer string, generation_prompt string, trace_valid boolean, answer_mode string, choices array<string>, metadata variant"
TAG = (
    "example_id string, dataset string, answer_mode string, candidate_index int, candidate_text string, candidate_is_correct boolean, problem_motif_label string, problem_motif_confidence double, problem_motif_cues array<string>, "
    "motif_label string, motif_confidence double, motif_cues array<string>, quality_label string, quality_confidence double, quality_cues array<string>"
)
EVENT = (
    "example_id string, candidate_id string, origin string, method_variant string, source_slot_id int, source_bucket string, before_parseable boolean, after_parseable boolean, before_answer_mode_match boolean, after_answer_mode_match boolean, "
    "before_correct boolean, after_correct boolean, selected_by_verifier boolean, selected_correct boolean, verifier_score double, repair_applied boolean, repair_type string, parser_status_before string, parser_status_after string, "
    "token_count_before int, token_count_after int, generation_seed string, repair_seed string"
)
TARGET = "row_id string, dataset string, variant string, paper struct<oracle:double,v_given_o:double,final:double>, release_status string, release_reference struct<oracle:double,v_given_o:double,final:double>, fallback_reference struct<oracle:double,v_given_o:double,final:double>, evidence string"
ARTIFACT = "id string, path string, kind string, required_for array<string>, expected_lines bigint, expected_values variant, expected_tolerance double"
