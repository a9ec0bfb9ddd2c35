"""Schemas of the engine's inputs."""

WORD = "struct<bbox:array<int>,area:int,bottom:int,cx:double,word_index:int>"
LINE = f"struct<line_index:int,bbox:array<int>,baseline_y:double,baseline_slope:double,baseline_intercept:double,baseline_rmse:double,x_height_h:double,script:string,words:array<{WORD}>,word_baseline_points:array<array<double>>,word_baseline_residuals:array<double>>"
SENTENCE = (
    "student_id string, school string, grade int, task_id string, task_name string, script string, crop_filename string, crop_bbox array<int>, "
    "median_rule_spacing_r double, median_slope double, sentence_baseline_slope double, sentence_baseline_intercept double, sentence_baseline_rmse double, "
    f"word_baseline_points array<array<double>>, word_baseline_residuals array<double>, physical_lines array<{LINE}>, lines array<{LINE}>, "
    "skeleton_graph struct<num_nodes:int,num_edges:int,junction_count:int,endpoint_count:int,total_path_length:double,mean_branch_length:double>, "
    "qa_flags struct<word_count_detected:int,line_count:int,low_contrast:boolean,manually_verified:boolean>, is_manually_adjusted boolean"
)
MANIFEST = (
    "student_id string, school string, school_name string, grade int, section string, roll_number int, label double, label_source string, "
    "match_status string, image_filename string, relative_image_path string, is_held_out boolean"
)
